"""Language ID, language-model scores and personal data."""

import itertools
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from podspark.llm import language_id, lm_score, pii

DATA = "/root/testdata/sf0.001"


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    train, test = docs.filter("doc_id % 4 <> 2"), docs.filter("doc_id % 4 = 2")
    got = language_id.identify(test, language_id.train(train), ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "12 34 !!", "de", 1), (4, "the cat and the dog " * 3000, "en", 1), (5, "der Hund und die Katze", "de", 1), (6, "x", None, 1), (7, "Ж", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, _text int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs.drop("_text"), language_id.train(docs), ["doc_id"]).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[5][0] == "de" and got[6][0] in ("en", "de") and got[7][0] != "und"
    assert language_id.train(docs.filter("lang is null")) is None
    few = language_id.train(docs, languages=1)
    assert list(few.families.values()) == [["en"]]
    assert language_id.identify(docs, None, ["doc_id"]).filter("lang_pred <> 'und'").isEmpty()
    assert language_id.identify(docs.limit(0), language_id.train(docs), ["doc_id"]).collect() == []


def plain_base(docs):
    words = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), None] for i, t in docs}
    train = [i for i in words if crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in train for w in words[i])
    n, v = sum(c.values()), len(c)
    return {i: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, w in words.items()}


def test_base_scores_with_and_without_rare_join(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "the\x0bof  THE")], "doc_id bigint, text string"))
    want = plain_base([(r.doc_id, r.text) for r in docs.collect()])
    marked = docs.withColumn("train", F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    runs = []
    for most, space, size, run_bytes in ((1 << 20, 96 << 20, 50_000, 1 << 18), (500, 96 << 20, 50_000, 1 << 18), (1 << 20, 20_000, 50_000, 900), (0, 96 << 20, 100, 1 << 18)):
        monkeypatch.setattr(lm_score, "BROADCAST_TOKENS", most)
        monkeypatch.setattr(lm_score, "BROADCAST_BYTES", space)
        monkeypatch.setattr(lm_score, "RUN", size)
        monkeypatch.setattr(lm_score, "RUN_BYTES", run_bytes)
        got = lm_score.score(marked).collect()
        runs.append(got)
        assert len(got) == len(want)
        for r in got:
            n, known, total, base = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-6 * max(1, -base)
    assert len({tuple(sorted((r.doc_id, round(r.score, 6)) for r in got)) for got in runs}) == 1  # the same by broadcast and by join
    assert all(r.score < 0 for r in got) and next(r.score for r in got if r.doc_id == 9001) == next(r.score for r in got if r.doc_id == 9002) > -12


def test_model_is_below_the_word_counts(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet").withColumn("train", F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    got = lm_score.score(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    # Where every word is known, the word counts are a code for texts up to white space.
    taught = [r for r in got if r.train]
    assert all(r.n_known == r.n_tokens for r in taught) and sum(r.score for r in taught) > sum(r.base_score for r in taught)
    # On held-out texts the base spends the same on every unknown word, however it is spelled: spell it by a code of byte counts.
    seen = Counter(b for r in taught for b in texts[r.doc_id].lower().encode())
    total = sum(seen.values())
    known = {w for r in taught for w in texts[r.doc_id].lower().split()}
    held = [r for r in got if not r.train]
    spelled = sum(math.log10((seen[b] + 0.5) / (total + 128)) for r in held for w in texts[r.doc_id].lower().split() if w not in known for b in f"{w} ".encode())
    assert sum(r.score for r in held) > 0.9 * (sum(r.base_score for r in held) + spelled)
    assert sum(-r.score for r in held) / math.log10(2) / sum(r.n_bytes for r in held) < 2.3  # bits per byte


def test_starting_weights_are_fitted_on_every_event_of_all_training_texts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["the", "then", "a", "of", "zebra", "x", "Ähre"], 12)) for _ in range(40)] + ["  two\n\nends ", "", "once"]
    train = [k % 4 != 1 for k in range(len(texts))]
    docs = spark.createDataFrame([*zip(range(len(texts)), texts, train, strict=True), (99, "w " * 30_000, False)], "doc_id int, text string, train boolean")
    seen = {}

    def spied(weights, cells, more, *args, fit=lm_score.fitted):
        seen["cells"] = Counter({r["cell"]: r["times"] for r in cells.collect()}) + Counter(dict(zip(*(x.tolist() for x in more), strict=True)))
        seen["weights"] = fit(weights, cells, more, *args)
        return seen["weights"]

    monkeypatch.setattr(lm_score, "fitted", spied)
    monkeypatch.setattr(lm_score, "RUN", 3)
    assert lm_score.score(docs, bits=12).count() == len(texts) + 1

    # The same from the texts, event by event: counts by dictionaries, from which each event is taken away when it is its turn.
    t = lm_score.tokens_of(pa.array([x for x, ok in zip(texts, train, strict=True) if ok]))
    code = lm_score.code_tree(np.bincount(t.symbols, minlength=257))
    words = lm_score.words_of(code, t.data, t.data_at)
    (one, three), steps = lm_score.word_slots(code, words, 12)
    _, length = lm_score._steps(code, words.cls)
    at = np.r_[0, np.cumsum(length)][words.place]
    ways, events = Counter(), []
    for k, name in enumerate(t.word.tolist()):
        data, place = t.data[t.data_at[name] : t.data_at[name + 1]].tobytes(), 0
        for d in range(len(data) + 1):
            for _ in range(length[words.place[name] + d]):
                j = at[name] + place
                s = steps[j]
                last = [(3, t.context[k], code.node[s])] if d == 0 else [(3, t.second[k], code.node[s])] if d == 1 else []
                keys = [(0, data[:d], code.node[s]), (1, one[j]), (2, three[j]), *last]
                events.append((keys, int(code.bit[s]), k, d))
                ways.update((x, events[-1][1]) for x in keys)
                place += 1
    odds = lambda x, bit: math.log((ways[x, 1] - bit + lm_score.PRIOR) / (ways[x, 0] - (not bit) + lm_score.PRIOR))
    want, before, run, total = Counter(), None, 0, None
    for keys, bit, k, _ in events:
        n = ways[keys[0], 0] + ways[keys[0], 1] - 1
        run = run + 1 if before == k and n == total else 0
        before, total = k, n
        gate = int(np.searchsorted(lm_score.SEEN, n, "right") * (len(lm_score.RUNS) + 1) + np.searchsorted(lm_score.RUNS, run, "right"))
        x = [np.rint(10 * odds(keys[0], bit)) / 10, *(odds(key, bit) for key in keys[1:])]
        cell = gate
        for v in x + [0] * (lm_score.INPUTS - len(x)):
            cell = cell << 6 | int(np.clip(np.rint(2 * v), -31, 31)) + 32
        want[cell << 1 | bit] += 1
    among = Counter({c: n for c, n in seen["cells"].items() if c >> 1 + 6 * lm_score.INPUTS == lm_score.GATES - 1})
    got = seen["cells"] - among
    assert sum(got.values()) + sum(among.values()) == int(code.length[t.symbols].sum())
    assert sum((got - want).values()) + sum((want - got).values()) <= 0.01 * sum(want.values())  # inputs that lie just between two halves

    # Newton steps end where the cost of all events is flat.
    cell, times = (np.array(x) for x in zip(*sorted(seen["cells"].items()), strict=True))
    start = np.tile(np.eye(1, lm_score.INPUTS), (lm_score.GATES, 1))
    slope = lm_score.slopes(seen["weights"].astype(float), cell, times)[:, : lm_score.INPUTS] + 20 * (seen["weights"] - start)
    assert np.abs(slope).max() < 1


def test_long_words_are_coded_in_runs_of_few_bytes(spark):
    rng = np.random.default_rng(5)
    words = lambda: " ".join("".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(20))
    docs = spark.createDataFrame([(k, words(), k % 5 != 1) for k in range(40)] + [(100, "x" * 300_000, True)], "doc_id int, text string, train boolean")
    want = plain_counts([(r.text, r.train) for r in docs.collect()])
    got = lm_score.score(docs).collect()
    assert len(got) == 41 and all(r.score < 0 and (r.n_known == r.n_tokens) == r.train for r in got) and {r.train_tokens for r in got} == {want}
    runs = lm_score._in_runs(lm_score.token_counts(docs.selectExpr("text", "train", "false AS fit"))).groupBy("run").agg({"word": "count", "pos": "max"}).collect()
    sizes = lm_score._in_runs(lm_score.token_counts(docs.selectExpr("text", "train", "false AS fit"))).selectExpr("run", "octet_length(word) AS n").groupBy("run").agg({"n": "sum"}).collect()
    assert all(r["count(word)"] == r["max(pos)"] + 1 for r in runs) and max(r["sum(n)"] for r in sizes) < lm_score.RUN_BYTES + 300_000
    assert sum(r["sum(n)"] > lm_score.RUN_BYTES + 2000 for r in sizes) <= 1  # the run with the one word that is longer


def test_broadcast_words_pass_through_the_driver_in_parts(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60).withColumn("train", F.col("doc_id") % 5 != 1)
    sizes = []

    def spied(names, n, codes, of=lm_score.Known.of):
        sizes.append(len(names))
        return of(names, n, codes)

    monkeypatch.setattr(lm_score.Known, "of", spied)
    lm_score.score(docs)
    assert len(sizes) > 1 and max(sizes) < 0.5 * sum(sizes)


def test_tasks_that_ask_for_rare_words_get_names_alone(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(40).withColumn("train", F.col("doc_id") % 5 != 1)
    want = {r.doc_id: round(r.score, 6) for r in lm_score.score(docs).collect()}
    sent, plain = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda context, value: sent.append(value) or plain(context, value))
    monkeypatch.setattr(lm_score, "BROADCAST_TOKENS", 300)
    assert {r.doc_id: round(r.score, 6) for r in lm_score.score(docs).collect()} == want
    known = [x for x in sent if isinstance(x, lm_score.Known)]
    names = [x for x in sent if isinstance(x, list)]
    assert len(names) == 1 and [len(x) for x in names[0]] == [len(k.names) for k in known] and sum(map(len, names[0])) > 0


def plain_counts(rows):
    return sum(len((t or "").split()) + 1 for t, train in rows if train)


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text", False), (2, None, False)], "doc_id int, text string, train boolean")
    got = {r.doc_id: r for r in lm_score.score(docs).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].score < 0
    assert lm_score.score(docs.limit(0)).collect() == []


def in_words(code, words):
    return lm_score.words_of(code, np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))


def little_code(words, m):
    counts = np.zeros(257)
    for w, k in zip(words, m, strict=True):
        for b in w:
            counts[b] += k
    counts[[0x20, 0x0A, 256]] = sum(m), 20, 10
    return lm_score.code_tree(counts), counts


def test_codes_of_words_equal_counts_of_all_words():
    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 6))) for _ in range(150)} | {b"", b"abcabcabcabcabc"})
    m = np.array([rng.randint(0, 5) for _ in words])
    code, _ = little_code(words, m.tolist())
    zeros, ones, at = [], [], [0]
    for w in words:
        for d in range(len(w) + 1):
            symbol = w[d] if d < len(w) else 0x20
            here = [(0 if d == len(v) else int(code.cls[v[d]]), k) for v, k in zip(words, m.tolist(), strict=True) if v[:d] == w[:d] and len(v) >= d]
            for s in range(code.start[symbol], code.start[symbol] + code.inner[symbol]):
                zeros.append(sum(k for c, k in here if code.low[s] <= c < code.mid[s]))
                ones.append(sum(k for c, k in here if code.mid[s] <= c < code.high[s]))
        at.append(len(zeros))
    want = lm_score.quantized(np.array(zeros, float), np.array(ones, float), np.array(at))
    for size in (1, 7, 50, 1000):
        runs = [(words[k : k + size], m[k : k + size]) for k in range(0, len(words), size)]
        sums: dict = {}
        for r, (part, counts) in enumerate(runs):
            for h, d, c, s in zip(*(x[0] if x.ndim > 1 else x for x in lm_score.edges(in_words(code, part), counts[None])), strict=True):
                found, where = sums.setdefault((int(h), int(d)), (Counter(), set()))
                found[int(c)] += s
                where.add(r)
        spanning = {k: (np.array(sorted(f)), np.array([f[c] for c in sorted(f)], float)) for k, (f, where) in sums.items() if len(where) > 1}
        got = np.concatenate([lm_score.word_codes(code, in_words(code, part), counts, spanning)[0] for part, counts in runs])
        assert (got == want).all(), size


def little_model(texts):
    t = lm_score.tokens_of(pa.array(texts))
    words = sorted((bytes(t.data[a:b]), int(n)) for a, b, n in zip(t.data_at[:-1], t.data_at[1:], t.names.view(np.int64), strict=True))
    times = dict(zip(t.names.view(np.int64).tolist(), np.bincount(t.word).tolist(), strict=True))
    m = np.array([times[n] for _, n in words])
    code, counts = little_code([w for w, _ in words], m.tolist())
    codes, at = lm_score.word_codes(code, in_words(code, [w for w, _ in words]), m, {})
    raw = codes.tobytes()
    known = lm_score.Known.of(np.array([n for _, n in words]), m, pa.array([raw[2 * a : 2 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()))
    rng = np.random.default_rng(1)
    odds = rng.normal(0, 1, (len(lm_score.ORDERS), 1 << 12)).astype(np.float32)
    first = lm_score.first_odds(code, rng.integers(0, 4, (2 << lm_score.FIRST_BITS, 256)).astype(float))
    weights = rng.normal(0.3, 0.1, (lm_score.GATES, lm_score.INPUTS)).astype(np.float32)
    return lm_score.Model(code, 12, odds, lm_score.end_odds(code, counts), first, weights), known


def events(m, known, texts):
    t = lm_score.tokens_of(pa.array(texts))
    _, codes, at, words = lm_score._gathered(t, m.code, [known])
    return lm_score.events_of(m, t, words, codes, at), t.at


TEXTS = ["the quick brown fox jumps over the lazy dog " * 40, "abc", "", "Äußerst schöne  Töne\n\n" * 30]


def test_a_prediction_depends_on_the_past_only():
    m, known = little_model(TEXTS)
    more = [*TEXTS, TEXTS[0][:900], TEXTS[0][:900] + "zzzz" * 200]
    together = lm_score.bits_of(m, *events(m, known, more))
    alone = [lm_score.bits_of(m, *events(m, known, [t]))[0] for t in more]
    assert np.allclose(together, alone, rtol=1e-4)
    # The events of a beginning do not change with what follows a word.
    a, at = events(m, known, ["the quick brown "])
    b, _ = events(m, known, ["the quick brown zebra"])
    n = int(a.per_symbol[:-1].sum())
    assert (a.inputs[:, :n] == b.inputs[:, :n]).all() and (a.gate[:n] == b.gate[:n]).all() and (a.bit[:n] == b.bit[:n]).all()


def test_bits_equal_a_plain_mixer():
    m, known = little_model(TEXTS)
    e, at = events(m, known, TEXTS)
    got = lm_score.bits_of(m, e, at)
    first = np.r_[0, np.cumsum(e.per_symbol)]
    for k in range(len(TEXTS)):
        weights, scale, shift, bits = m.weights.astype(float), 1.0, 0.0, 0.0
        for block in range(at[k], at[k + 1], lm_score.BLOCK):
            slopes, counts, on_scale, on_shift, seen = np.zeros_like(weights), np.full(lm_score.GATES, 8.0), 0.0, 0.0, 64.0
            for j in range(first[block], first[min(block + lm_score.BLOCK, at[k + 1])]):
                x, g = e.inputs[:, j].astype(float), int(e.gate[j])
                z = weights[g] @ x
                p = 1 / (1 + math.exp(-max(-13, min(13, scale * z + shift))))
                bits -= math.log2(p if e.bit[j] else 1 - p)
                error = p - e.bit[j]
                slopes[g] += error * scale * x
                counts[g] += 1
                on_scale, on_shift, seen = on_scale + error * z, on_shift + error, seen + 1
            weights -= lm_score.RATE * slopes / counts[:, None] / 4
            scale, shift = scale - lm_score.TAIL_RATE * on_scale / seen / 4, shift - lm_score.TAIL_RATE * on_shift / seen
        assert abs(bits - got[k]) < 1e-3 * max(1, bits)


def test_the_tree_is_a_code():
    code, _ = little_code([b"ab", b"b"], [3, 1])
    assert abs(sum(0.5 ** int(n) for n in code.length) - 1) < 1e-12


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return pii.in_order(out)


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(2)
    for alphabet in ("a.@-1", "12.5 -", "+1 (0).-", "ab@c.d e1+", "4111 -"):
        for _ in range(3000):
            text = "".join(rng.choice(list(alphabet), rng.integers(0, 40)))
            assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("x 4111 1111 1111 1111 y") == [("card", 2, 21)]
    pii.base_spans("9" * 200_000 + "a" * 200_000 + "@")  # long runs take one pass


def test_tagger_finds_what_it_was_taught():
    m = pii.production_tagger()
    lines = pii.labelled_lines(200, seed=77)
    found = pii.find(m, [t for t, _ in lines])
    gold = {(k, s) for k, (_, spans) in enumerate(lines) for s in spans}
    got = {(k, s) for k, (_, spans) in enumerate(found) for s in spans}
    assert len(gold & got) >= 0.85 * len(gold) and len(gold & got) >= 0.9 * len(got)


def other_lines():
    """Sentences made in another way than the training lines, each with one span that the patterns miss, or with none."""
    rng = random.Random(12)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    h = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    names = ["maria.keller", "jdoe", "peter_w", "info", "anna-lena"]
    hosts = ["mail.example", "uni-bonn", "post", "company"]

    def card():
        body = "4" + d(14)
        body += next(x for x in "0123456789" if pii.luhn(body + x))
        return ".".join(body[k : k + 4] for k in range(0, 16, 4))

    spans = [
        ("secret", lambda: h(32), ["The config says token = \"{}\" and nothing else.", "login with password={} please", "export API_KEY={} before the run"]),
        ("secret", lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), ["we found {} in the log file", "use the key {} for the bucket", "{}"]),
        ("email", lambda: f"{rng.choice(names)} (at) {rng.choice(hosts)}.org", ["Please write to {} for more.", "contact: {}"]),
        ("phone", lambda: f"({d(3)}) {d(3)}-{d(4)}", ["Call {} after six.", "Telephone {} or come by"]),
        ("phone", lambda: f"0{d(3)} {d(3)} {d(4)}", ["Ruf mich an unter {} heute", "Tel. {}"]),
        ("ip", lambda: f"{rng.randint(1, 255)}[.]{rng.randint(0, 255)}[.]{rng.randint(0, 255)}[.]{rng.randint(0, 255)}", ["traffic to {} was blocked", "host {} is down"]),
        ("card", card, ["paid with {} yesterday", "my card {} was lost"]),
    ]
    out = []
    for _ in range(40):
        for kind, make, frames in spans:
            value, frame = make(), rng.choice(frames)
            at = frame.index("{}")
            out.append((frame.format(value), [(kind, at, at + len(value))]))
        out += [(f"In {rng.randint(1900, 2030)} the {rng.randint(2, 99)} members met at {d(2)}:{d(2)} in room {d(3)}.", []), (f"Version {d(1)}.{d(1)} costs {d(2)}.{d(2)} euros, see page {d(3)}.", []), (f"commit {h(40)} fixes it", [])]
    return out


def test_tagger_adds_what_the_patterns_miss_on_other_lines():
    """Only the tagger's own spans are counted, on lines it has not been trained on."""
    lines = other_lines()
    found = pii.find(pii.production_tagger(), [t for t, _ in lines])
    gold = {(k, s) for k, (_, spans) in enumerate(lines) for s in spans}
    own = {(k, s) for k, (base, spans) in enumerate(found) for s in spans if s not in base}
    gold -= {(k, s) for k, (base, _) in enumerate(found) for s in base}
    assert len(gold & own) >= 0.75 * len(gold) and len(gold & own) >= 0.85 * len(own), (len(gold), len(own), len(gold & own))
    assert sum(bool(found[k][1]) for k, (_, spans) in enumerate(lines) if not spans) <= 12


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    m = pii.Tagger(*(w.astype(np.float64) + rng.normal(0, 0.1, w.shape) for w in pii.blank_tagger(3, 1)))
    codes, gold = rng.integers(0, pii.CODES, (2, 7)), rng.integers(0, pii.TAGS, (2, 7))
    _, grads = pii.gradients(m, codes, gold)
    for j, w in enumerate(m):
        spots = [tuple(rng.integers(0, n) for n in w.shape) for _ in range(25)] if j else [(way, codes[0, 3], k) for way in (0, 1) for k in range(12)]
        for spot in spots:
            sides = []
            for step in (1e-3, -1e-3):
                moved = [x.copy() for x in m]
                moved[j][spot] += step
                sides.append(pii.gradients(pii.Tagger(*moved), codes, gold)[0])
            assert abs((sides[0] - sides[1]) / 2e-3 - grads[j][spot]) < 2e-3 * max(1, abs(grads[j][spot])), (j, spot)


def test_best_path_equals_all_paths():
    rng = np.random.default_rng(3)
    scores, moves = rng.normal(0, 1, (4, 3, 5)), rng.normal(0, 1, (5, 5))
    got = pii.best_path(scores, moves)
    for row in range(3):
        value = lambda p: sum(scores[t, row, p[t]] for t in range(4)) + sum(moves[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert tuple(got[row]) == max(itertools.product(range(5), repeat=4), key=value)


def test_many_spans_are_reconciled_in_time():
    import time

    took = []
    for n in (1000, 4000):
        text = "call (030) 555-0199 " * n
        start = time.process_time()
        pii.tag(pii.production_tagger(), [text])
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 0.5


def test_trained_weights_are_kept(spark, monkeypatch):
    m = pii.production_tagger()
    made = []
    monkeypatch.setattr(pii, "train", lambda *a: made.append(1) or m)
    monkeypatch.setattr(pii.train, "__defaults__", None, raising=False)
    for _ in range(2):
        pii.production_tagger.cache_clear()
        got = pii.production_tagger(spark)
        assert all(np.array_equal(a, b) for a, b in zip(got, m, strict=True))
    assert len(made) <= 1
    pii.production_tagger.cache_clear()


def test_spans_do_not_depend_on_the_place_in_a_long_text(spark):
    filler = "lorem ipsum dolor sit amet " * 400
    text = filler + "write to jo.doe@mail.example.org or +49 170 555 0199 now " + filler
    rows = [(1, text), (2, None), (3, ""), (4, "no digits"), (4, "no digits")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r for r in pii.detect(docs, ["doc_id"], redact=True).collect()}
    assert [s.kind for s in got[1].spans] == ["email", "phone"] and text[got[1].spans[0].start : got[1].spans[0].end] == "jo.doe@mail.example.org"
    assert "<EMAIL> or <PHONE> now" in got[1].redacted and got[2].redacted is None and got[2].spans == [] and got[4].redacted == "no digits"
    assert pii.detect(docs.limit(0), ["doc_id"]).collect() == []


def test_weights_are_plain_arrays():
    import pickle

    import pytest

    m = pii.Tagger(*(np.arange(k + 2.0) for k in range(len(pii.Tagger._fields))))
    assert all((a == b).all() for a, b in zip(pii.unpacked(pii.packed(m)), m, strict=True))
    with pytest.raises(ValueError):
        pii.unpacked(pickle.dumps(tuple(m)))
