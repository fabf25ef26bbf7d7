"""Quality rules, mixing, decontamination, page text and the pipeline on odd rows."""

import random
import re
import time
from collections import Counter

from test_near_join import brute

import corpus_pipeline
from podspark.llm import common, decontaminate, html_extract, mixing, pii, quality
from podspark.llm.html_extract import read_page

DATA = "/root/testdata/sf0.001"


def test_quality_on_odd_rows(spark):
    clean = "The cat and the dog went to the house of a friend, and it was not far from here."
    rows = [(1, None), (2, ""), (3, clean), (3, clean), (4, "# # # $ % & | < > * " * 3), (5, "one two three four five six " * 40), (6, "\n\n".join(["a line of the text is here"] * 3)), (7, "word " * 5 + "é " * 5)]
    got = {r.doc_id: r for r in quality.apply_rules(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert not got[1].kept and got[1].base_failed and got[2].n_words == 0 and got[3].kept and not got[4].kept
    assert got[5].n_repeat_words == 240 and got[5].base_failed and got[6].n_dup_lines == 2 and got[7].word_chars == 25
    assert quality.apply_rules(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_repeat_words_equal_plain_count(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r.n_repeat_words for r in quality.apply_rules(docs).collect()}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        assert got[r.doc_id] == len({p for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)})


def test_mix_meets_targets(spark):
    docs = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    sources = {}
    for r in got:
        s = sources.setdefault(r.source, [0, r.source_size, r.target, 0])
        s[0] += r.taken
        s[3] = max(s[3], r.size)
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    total = sum(s[1] for s in sources.values())
    assert abs(sum(s[2] for s in sources.values()) - total) < 1e-6 * total
    for taken, size, target, largest in sources.values():
        assert target <= 3 * size * (1 + 1e-12) and abs(taken - target) <= largest / 2 + 1


def test_mix_on_odd_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (3, "", "y"), (4, "one two", None), (5, "w " * 500, "z"), (None, "q r", "z")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()
    assert len(got) == 7 and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(spark.createDataFrame([], "doc_id int, text string, source string")).collect() == []
    # Half of a source without ids is drawn like any other.
    rows = [(None, f"w{k} b c d", "a") for k in range(50)] + [(k, "x y z v", "a") for k in range(50)] + [(k, "p q r s t", "b") for k in range(100, 150)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()
    taken = {s: sum(r.taken for r in got if r.source == s) for s in "ab"}
    assert all(abs(taken[r.source] - r.target) <= 5 for r in got) and any(r.copies for r in got if r.doc_id is None)
    alone = mixing.mix(spark.createDataFrame([(1, "a b", "s"), (2, "c", "s")], "doc_id int, text string, source string")).collect()
    assert sum(r.taken for r in alone) == 3


def test_decontamination_on_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (4, "..."), (10, "Short, ITEM"), (1, item)], "item_id int, text string")
    rows = [(1, f"x {item.upper()} y"), (2, None), (3, ""), (4, "a short-item, here"), (5, "short x item"), (4, "a short-item, here"), (6, " ".join(item.split()[:9])), (7, item[6:] + " alpha"), (8, f"{item} {item}")]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id int, text string, items int, words string")
    for most in (50_000, 0):
        decontaminate.BROADCAST_WINDOWS = most
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, items).collect()}
        assert got[1] == (14, 12, ["1"]) and got[2] == (0, 0, []) and got[4] == (4, 2, ["10", "2"]) and got[5] == (3, 0, [])
        assert got[6] == (9, 0, []) and got[7] == (12, 11, ["1"]) and got[8] == (24, 24, ["1"])
    decontaminate.BROADCAST_WINDOWS = 50_000
    assert len(decontaminate.decontaminate(docs, items).collect()) == len(rows)
    assert all(not r.contaminated for r in decontaminate.decontaminate(docs, items.limit(0)).collect())
    assert decontaminate.decontaminate(docs.limit(0), items).collect() == []


def test_decontamination_finds_hits_without_an_id(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(1, item)], "item_id int, text string")
    docs = spark.createDataFrame([(None, f"x {item}"), (None, f"{item} y"), (None, "clean"), (None, None), (1, f"x {item}"), (2, "clean")], "doc_id int, text string")
    for most in (50_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
        got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in decontaminate.decontaminate(docs, items).collect())
        assert got == [(0, 0, 0, False), (0, 1, 0, False), (0, 13, 12, True), (0, 13, 12, True), (1, 13, 12, True), (2, 1, 0, False)]
        assert decontaminate.matches(docs, decontaminate.windows_of(items)).filter("doc_id is null").select("text_hash").distinct().count() == 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">X</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>
<article><header><h1>Caf&eacute; &amp;  more</h1></header><p><b>One <i>two</i><br>three.<br><p>Four&nbsp;five<p>Six <script>no()</script>seven</p>
<form><input value="a>b"><button>Go</button></form><div class="comments"><p>Reader says</p></div><ul><li>eight<li>nine</ul></article>
<aside>Side</aside><footer>&copy; 2020</footer></body></html>"""


def test_page_with_article():
    assert read_page(PAGE)[1] == "Café & more\nOne two three.\nFour five\nSix seven\neight\nnine"


def test_odd_pages():
    assert read_page("")[1] == ""
    assert read_page("plain < text &lt;")[1] == "plain < text <"
    assert read_page("<p>a<p>b <b>c")[1] == "a\nb c"
    assert read_page("<div hidden>x</div><div style='display: none'>y</div><p>z</p></span></div>")[1] == "z"
    assert read_page("<p>" + "long " * 50_000)[1] == ("long " * 50_000).strip()


def test_nested_pages_take_time_in_proportion():
    import time

    for unit in ("<b>x", "<div>", "<p>x<b>", "<i><hr>", "<li>x", "<b><td>", "</b><b>x"):
        took = []
        for n in (4000, 16000):
            start = time.process_time()
            read_page(unit * n)
            took.append(time.process_time() - start)
        assert took[1] < 9 * took[0] + 0.2, (unit, took)


SHARE = "<div><span>Send this to</span> <b>your friends</b></div>"


def blocky_page(k, marked):
    """Repeated blocks with no telling name: before, in and after the text; two articles in five quote one paragraph."""
    quote = "<p>To be or not to be.</p>" if k % 5 < 1 else ""
    body = f"<h1>Story {k}</h1><p>Part one of {k}.</p>{SHARE}{quote}<p>Thanks for reading.</p><p>Part {k * 7} ends.</p>"
    return f"<body><div><span>Brand</span> since 1999</div>{f'<article>{body}</article>' if marked else f'<section>{body}</section>'}<div>Same end</div></body>"


def test_recurring_blocks_go_in_and_out_of_articles(spark):
    for marked in (True, False):
        rows = [(k, "https://a.example/x", blocky_page(k, marked)) for k in range(20)] + [(100 + k, "https://a.example/y", blocky_page(3, marked)) for k in range(30)]
        rows += [(200 + k, "https://b.example/", blocky_page(k, marked)) for k in range(4)]
        pages = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
        got = {r.page_id: r.text for r in html_extract.extract(pages, ["page_id"]).collect()}
        # By a plain count: blocks on at least 40 % of the 20 different pages of a host go, a quotation on 4 of them stays.
        for k in range(20):
            quote = "To be or not to be.\n" if k % 5 < 1 else ""
            assert got[k] == f"Story {k}\nPart one of {k}.\n{quote}Part {k * 7} ends.", marked
        assert all(got[100 + k] == got[3] for k in range(30))
        kept = "Story 1\nPart one of 1.\nSend this to your friends\nThanks for reading.\nPart 7 ends."
        assert got[201] == (kept if marked else f"Brand since 1999\n{kept}\nSame end")


def test_templates_alone_without_tags_and_names(spark):
    rows = [(k, "https://a.example/x", blocky_page(k, True).replace("<div>", "<nav>").replace("</div>", "</nav>")) for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages, ["page_id"], marks=False).collect()}
    assert got[1] == "Story 1\nPart one of 1.\nPart 7 ends."


def test_templates_are_found_and_removed(spark):
    body = lambda k: f"<html><body><div class='top'><span>Brand</span> since 1999</div><div class='x'><p>Story {k} is new.</p><p>It has part {k * 7}.</p></div><div>Same end</div></body></html>"
    rows = [(k, f"https://User@Site.example:80/{k}", body(k)) for k in range(12)] + [(50, "https://other.example/", body(50)), (51, None, None), (52, "bad url", ""), (53, "https://site.example/3", body(3))]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
    for most in (100_000, 0):
        html_extract.BROADCAST_SUBTREES = most
        got = {r.page_id: r.text for r in html_extract.extract(pages, ["page_id", "url"]).collect()}
        assert len(got) == 16 and got[3] == got[53] == "Story 3 is new.\nIt has part 21." and got[51] == got[52] == ""
        assert got[50] == "Brand since 1999\nStory 50 is new.\nIt has part 350.\nSame end"
    html_extract.BROADCAST_SUBTREES = 100_000
    assert html_extract.extract(pages.limit(0), ["page_id"]).collect() == []


def test_unclosed_tags_cost_no_scan_each():
    for start in ('<a href="', "<a ", "<a href='\"", "<abc", '<a ">"', "</b", "<div class=x"):
        begun = time.perf_counter()
        read_page(start * 40_000 + "end")
        assert time.perf_counter() - begun < 5, start
    read_page("<a " + "a" * 400_000 + ">x</a>")
    # What is never closed is text; what is closed is a tag, whatever stands in its quotes.
    assert read_page("a < b <i>c</i> <b")[1] == "a < b c <b"
    assert read_page("<p title='a > b' id=\"<i>\">x</p> y")[1] == "x\ny"


def test_tags_are_closed_as_by_a_plain_scan():
    def plain(page, at):
        while at < len(page):
            if page[at] == ">":
                return True
            later = page.find(page[at], at + 1) if page[at] in "\"'" else -1
            at = (later if later >= 0 else at) + 1
        return False

    rng = random.Random(3)
    for _ in range(300):
        page = "".join(rng.choice("<a>\"' ") for _ in range(rng.randrange(30)))
        closing = html_extract._Closing(page)
        assert [closing(k) for k in range(len(page) + 1)] == [plain(page, k) for k in range(len(page) + 1)]


def test_forms_and_names_that_hold_the_page_stay():
    assert read_page("<body><form><div><main><p>Long text here.</p></main><input></form></body>")[1] == "Long text here."
    assert read_page("<body><form action=x><p>Long text here.</p></form><p>x</p></body>")[1] == "Long text here.\nx"
    assert read_page("<body><p>The long story of the page.</p><form>Mail <input></form></body>")[1] == "The long story of the page."
    parts = "<div class='social-science'><p>One two.</p></div><section id='notice-to-readers'>Kept.</section>"
    gone = "<div class='ad-box'>no</div><div class='related-work x'><a>all</a> <a>links</a></div><div class='comment-on-this'>I say</div><div class='cookie_banner'>We</div>"
    assert read_page(f"<article>{parts}{gone}</article>")[1] == "One two.\nKept."
    assert read_page(f"<body>{parts}{gone}</body>")[1] == "One two.\nKept."


def test_pages_of_the_tables_keep_their_articles(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages, ["page_id"]).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = re.sub(r"<[^>]*>", " ", inner.replace("</p>", "\n").replace("</h1>", "\n"))
        assert html_extract.entities.unescape(want).split() == got[r.page_id].split()


def plain_hits(docs, items):
    """Documents that hold a window of an item, by plain search."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    return {i for i, t in docs for w in (words(t),) for n in sizes if any(tuple(w[k : k + n]) in windows for k in range(len(w) - n + 1))}


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "人人生而自由在尊严和权利上一律平等他们赋有理性和良心",
    "qzx vkjw pqrt zzxk bvnm wqpl kjhg xcvz mnbq wert plok qaz wsx edc rfv",
    "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Qgb2YgYmFzZTY0IGVuY29kaW5nIGFuZCBzbyBvbg",
    "### 12 34 56 $$$ 78 90 the 1234 5678 &&& %%% 9999",
]
FAMILIAR = [
    "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience.",
    "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt.",
    "the",
    "Tel. 0170 555: the cat and the dog went to the house",
]


def test_language_stage_rejects_what_is_in_no_labelled_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    added = [(9100 + k, t, None, "s", len(t)) for k, t in enumerate(FOREIGN)] + [(9200 + k, t, None, "s", len(t)) for k, t in enumerate(FAMILIAR)]
    got = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(added, docs.schema)), DATA).collect()}
    assert not {i for i in got if 9100 <= i < 9200}
    assert {r.doc_id for r in docs.collect()} <= got and {9200 + k for k in range(len(FAMILIAR))} <= got


def test_language_stage_with_one_language_and_with_none(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("lang = 'en'")
    junk = spark.createDataFrame([(9100 + k, FOREIGN[k], None, "s", 1) for k in (4, 5, 6, 7)], docs.schema)
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(junk), DATA).collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.identify_language(spark, junk, DATA).collect() == []
    assert corpus_pipeline.identify_language(spark, docs.limit(0), DATA).collect() == []


def plain_groups(docs, width=5, percent=80):
    """Groups of row numbers joined by Jaccard similarity of their shingles, by all pairs; texts without words are alone."""
    sets = []
    for t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if group[a] != group[b] and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return group


def test_near_copies_go_at_five_words_and_80_percent(spark):
    words = lambda k: [f"w{k}x{n}" for n in range(100)]

    def changed(k, *places):
        return " ".join("new" if n in places else w for n, w in enumerate(words(k)))

    # 86/106 = 0.811 (0.848 in shingles of four words), 81/111 = 0.730, and a chain.
    texts = [changed(0), changed(0, 30, 60), changed(1), changed(1, 20, 45, 70), changed(2), changed(2, 30), changed(2, 30, 60), changed(2, 30, 60, 80)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = {min(i for i, h in enumerate(g) if h == x) for g in [plain_groups(texts)] for x in g}
    assert want == {0, 2, 3, 4}
    assert {r.doc_id for r in corpus_pipeline.join_near_copies(spark, docs, DATA).collect()} == want


def test_near_copies_of_the_tables_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    group = plain_groups([t for _, t in rows])
    want = {min(i for (i, _), h in zip(rows, group, strict=True) if h == g) for g in set(group)}
    assert {r.doc_id for r in corpus_pipeline.join_near_copies(spark, docs, DATA).collect()} == want


def test_one_row_of_each_group_stays(spark, monkeypatch):
    text = lambda k, *places: " ".join("new" if n in places else f"w{k}x{n}" for n in range(100))
    rows = [(1, text(0)), (1, text(0)), (1, text(0)), (2, text(0, 50)), (None, text(0)), (None, text(1)), (None, text(1)), (None, text(1, 50)), (None, text(2))]
    # An id with two texts, one of them a copy; ids that are missing come last; texts without words stay.
    rows += [(3, text(3)), (4, text(3)), (4, text(4)), (None, text(5)), (9, text(5, 50)), (7, None), (7, None), (8, ""), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    for most in (500_000, 0):
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", most)
        got = [(r.doc_id, r.text) for r in corpus_pipeline.join_near_copies(spark, docs, DATA).collect()]
        worded = Counter((i, t.split("x")[0]) for i, t in got if t and t.strip())
        assert worded == Counter([(1, "w0"), (None, "w1"), (None, "w2"), (3, "w3"), (4, "w4"), (9, "w5")])
        assert Counter(i for i, t in got if not (t and t.strip())) == Counter({7: 2, 8: 1, None: 1})
        assert (9, text(5, 50)) in got and len(got) == 10
    assert corpus_pipeline.join_near_copies(spark, docs.limit(0), DATA).collect() == []


def test_rows_that_pass_the_filter_of_marked_rows_wrongly_stay(spark, monkeypatch):
    text = lambda k: " ".join(f"w{k}x{n}" for n in range(30))
    rows = [(k, text(k)) for k in range(60)] + [(100 + k, text(k)) for k in range(12)] + [(200, text(70))] * 3
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    for name, value in (("FILTER_WORDS", 1), ("KEY_BITS", 1)):
        monkeypatch.setattr(common, name, value)
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", 0)
    assert sorted(r.doc_id for r in corpus_pipeline.join_near_copies(spark, docs, DATA).collect()) == [*range(60), 200]


def test_stages_keep_columns_with_clashing_names(spark):
    rows = [(1, "the cat and the dog and the house of a friend", "en", "s", 9, 5, "x", 7, 1, 2), (2, "der Hund und die Katze und das Haus", "de", "s", 9, 6, "y", 8, 1, 2), (2, "der Hund und die Katze und das Haus", "de", "s", 9, 6, "y", 8, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _hash int, _first string, _n int, _row int, `_Copies` int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns and {(r.doc_id, r._hash, r._first, r._n) for r in got.collect()} == {(1, 5, "x", 7), (2, 6, "y", 8)}
    assert corpus_pipeline.mix_sources(spark, docs, DATA).columns[: len(docs.columns)] == docs.columns


def test_each_row_is_mixed_by_itself(spark, monkeypatch):
    # Two sources of equal rows: the targets fall between whole copies of a source.
    rows = [(1, "a b c d", "x")] * 40 + [(None, f"n{k} b c d", "y") for k in range(41)] + [(2, "p q r s", "y"), (2, "t u v w", "y"), (3, None, "x"), (3, None, "x")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    goals = {r.source: r.target for r in mixing.mix(docs).collect()}
    for most in (500_000, 0):
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", most)
        got = corpus_pipeline.mix_sources(spark, docs, DATA).collect()
        taken = Counter()
        for r in got:
            assert r.taken == 4 * r.copies and r.copies > 0
            taken[r.source] += r.taken
        assert all(abs(taken[s] - goal) <= 4 / 2 + 1 for s, goal in goals.items())
        assert len(got) <= len(rows) and all(n == 1 for (i, t), n in Counter((r.doc_id, r.text) for r in got).items() if i is None)


def test_pipeline_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "12 34", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(odd)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, DATA)
        if name != "mixing":
            assert new.columns == docs.columns
        before, after = docs.collect(), new.collect()
        ids = {r.doc_id for r in after}
        if name == "language_id":
            # Invented prose in a known language stays; what has no letter goes.
            assert not ids & {9001, 9002, 9003} and len(after) >= 0.97 * len(before)
        elif name == "near_join":
            assert ids == {i for i, _, least in brute([(r.doc_id, r.text) for r in before]) if i == least} and len(after) == len(ids)
        elif name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert ids == {r.doc_id for r in before} - plain_hits([(r.doc_id, r.text) for r in before], items)
        elif name == "pii":
            texts = {r.doc_id: r.text for r in before}
            assert ids == set(texts)
            for r in after:
                spans, clean, upto = pii.find(pii.production_tagger(), [texts[r.doc_id]])[0][1], "", 0
                for kind, start, end in spans:
                    if start >= upto:
                        clean += texts[r.doc_id][upto:start] + f"<{kind.upper()}>"
                    upto = max(upto, end)
                assert r.text == clean + texts[r.doc_id][upto:] and r.n_chars == len(r.text)
        else:
            taken = Counter()
            for r in after:
                assert 1 <= r.copies <= 3 and r.taken == r.copies * len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
                taken[r.source] += r.taken
            goals = {r.source: r.target for r in mixing.mix(docs).collect()}
            largest = max(len(r.text.split()) for r in before)
            assert all(abs(taken[s] - goal) <= largest / 2 + 1 for s, goal in goals.items())
        docs = spark.createDataFrame(after, new.schema)
        seen.append((name, len(before), len(after)))
    assert [s[0] for s in seen] == ["language_id", "near_join", "decontamination", "pii", "mixing"] and seen[-1][2] > 0
