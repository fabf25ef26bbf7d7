"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF on top that adds spans.

The patterns find emails, addresses, cards and phones in their plain spelling.  The tagger has learnt
other spellings of these (written out or split differently), and secrets: passwords, tokens and keys, which no
pattern describes.

It reads windows of ``WIDTH`` characters that overlap by half.  A window's tags are the
best path under learned transitions; spans from overlapping windows are reconciled over the whole
text: a span cut by a window's edge yields to one that is seen whole, then the longer one wins,
then the earlier one, and no two kept spans overlap.  A span must hold a digit, an at-sign or a bracketed
"at" to be kept, so windows without any are not decoded: they could add nothing.

Everything is trained here, in numpy, from labelled spans; ``labelled_lines`` makes them.  Trained weights are
kept in the shared checkpoint folder under a hash of what they were trained on.

Defined results: a null or empty text has no spans; repeated rows get the same spans; an empty
table gives an empty result; texts of any length are read whole, in memory in proportion to the
text; input columns other than those asked for are dropped, and may have any names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache
from io import BytesIO
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from podspark.llm.arrow_text import slices
from podspark.llm.common import fresh
from podspark.sources.tables import checkpoint_root

KINDS = ("email", "ip", "card", "phone")
#: What the tagger finds.
TAGGED = (*KINDS, "secret")
#: What a text, and a window, must hold for the tagger to look at it.
TELLING = r"[0-9@]|[(\[][Aa][Tt][)\]]"
WIDTH = 96

Span = tuple[str, int, int]

# ---------------------------------------------------------------- fixed patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match cannot start inside a run of digits: the run's own start would have matched before.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at-sign outwards so that long runs cost one pass."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind."""
    out = [("email", *x) for x in _emails(text)]
    ips = list(_IP.finditer(text))
    out += [("ip", *m.span()) for m in ips if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], TAGGED.index(s[0])))


def digest(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


# ---------------------------------------------------------------- the tagger

TAGS = 1 + 2 * len(TAGGED)  # outside, then begin and inside of each kind
_SIGNS = "@.-+()_ \n:/,;='\"#%*$&!?|<>[]{}"


def _code(c: str) -> int:
    if "0" <= c <= "9":
        return 1
    if "a" <= c <= "z":
        return 2 + ord(c) - 97
    if "A" <= c <= "Z":
        return 28
    if (k := _SIGNS.find(c)) >= 0:
        return 30 + k
    return 29 if c.isalpha() else 0


CODES = 30 + len(_SIGNS)
_TABLE = np.array([_code(chr(c)) for c in range(0x250)], np.int64)


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x250, _TABLE[np.minimum(points, 0x24F)], 29)


class Tagger(NamedTuple):
    """Weights of both directions (input rows, recurrent), the output layer and the transitions."""

    input: np.ndarray
    recurrent: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(codes: np.ndarray, w_in: np.ndarray, w_h: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (steps, directions, rows, units) of codes (directions, rows, steps), and what the way back needs."""
    units = w_h.shape[1]
    h = c = np.zeros((*codes.shape[:2], units), np.float32)
    states, trace = np.empty((codes.shape[2], *codes.shape[:2], units), np.float32), []
    way = np.arange(len(codes))[:, None]
    for t in range(codes.shape[2]):
        gates = w_in[way, codes[:, :, t]] + h @ w_h
        ifo, g = _sigmoid(gates[..., : 3 * units]), np.tanh(gates[..., 3 * units :])
        i, f, o = ifo[..., :units], ifo[..., units : 2 * units], ifo[..., 2 * units :]
        new = f * c + i * g
        tanh = np.tanh(new)
        trace.append((h, c, i, f, o, g, tanh))
        c, h = new, o * tanh
        states[t] = h
    return states, trace


def _lstm_back(codes: np.ndarray, w_in: np.ndarray, w_h: np.ndarray, trace: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input rows and the recurrent weights of both directions."""
    dh = dc = np.zeros(d_states.shape[1:], np.float32)
    d_h = np.zeros_like(w_h)
    back, every = w_h.transpose(0, 2, 1), []
    for t in range(len(trace) - 1, -1, -1):
        h, c, i, f, o, g, tanh = trace[t]
        dh = dh + d_states[t]
        dc = dc + dh * o * (1 - tanh * tanh)
        d = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g * g)], 2)
        every.append(d)
        d_h += h.transpose(0, 2, 1) @ d
        dh, dc = d @ back, dc * f
    d_in = np.zeros_like(w_in)
    flat = np.stack(every[::-1])  # (steps, directions, rows, gates)
    for way in range(len(codes)):
        code, d = codes[way].T.ravel(), flat[:, way].reshape(-1, flat.shape[-1])
        order = np.argsort(code, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
        d_in[way, code[order][edge]] = np.add.reduceat(d[order], edge)
    return d_in, d_h


def _both_ways(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes, codes[:, ::-1]])


def _joined(states: np.ndarray) -> np.ndarray:
    return np.concatenate([states[:, 0], states[::-1, 1]], 2)


def emissions(m: Tagger, codes: np.ndarray) -> np.ndarray:
    """Tag scores (steps, rows, tags)."""
    return _joined(_lstm(_both_ways(codes), m.input, m.recurrent)[0]) @ m.out + m.bias


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def _crf_gradient(scores: np.ndarray, moves: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood and its gradients for scores and transitions."""
    steps, rows, _ = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, steps):
        alpha[t] = scores[t] + _logsum(alpha[t - 1][:, :, None] + moves, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(moves + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _logsum(alpha[-1], 1)
    d_scores = np.exp(alpha + beta - total[:, None])
    d_moves = np.zeros_like(moves)
    for t in range(1, steps):
        d_moves += np.exp(alpha[t - 1][:, :, None] + moves + (scores[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
    who, when = np.arange(rows), np.arange(steps)
    path = scores[when[:, None], who, gold.T].sum(0) + moves[gold[:, :-1], gold[:, 1:]].sum(1)
    d_scores[when[:, None], who, gold.T] -= 1
    np.add.at(d_moves, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), -1)
    return float((total - path).mean()), d_scores / rows, d_moves / rows


def best_path(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Most probable tags (rows, steps)."""
    steps, rows, tags = scores.shape
    best, came = scores[0], np.empty((steps, rows, tags), np.int8)
    for t in range(1, steps):
        ways = best[:, :, None] + moves
        came[t] = ways.argmax(1)
        best = np.take_along_axis(ways, came[t][:, None, :].astype(np.int64), 1)[:, 0] + scores[t]
    path = np.empty((rows, steps), np.int64)
    path[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = came[t][np.arange(rows), path[:, t]]
    return path


def gradients(m: Tagger, codes: np.ndarray, gold: np.ndarray) -> tuple[float, Tagger]:
    """Mean negative log-likelihood of the gold tags, and its gradient for all weights."""
    both = _both_ways(codes)
    states, trace = _lstm(both, m.input, m.recurrent)
    joined = _joined(states)
    loss, d_scores, d_moves = _crf_gradient(joined @ m.out + m.bias, m.moves, gold)
    d_joined = (d_scores @ m.out.T).astype(np.float32)
    units = m.recurrent.shape[1]
    d_states = np.stack([d_joined[:, :, :units], d_joined[::-1, :, units:]], 1)
    d_in, d_h = _lstm_back(both, m.input, m.recurrent, trace, d_states)
    return loss, Tagger(d_in, d_h, np.tensordot(joined, d_scores, ([0, 1], [0, 1])), d_scores.sum((0, 1)), d_moves)


def blank_tagger(units: int, seed: int) -> Tagger:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
    m = Tagger(draw(2, CODES, 4 * units), draw(2, units, 4 * units), draw(2 * units, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32))
    m.input[:, :, units : 2 * units] += 1  # remember at first
    return m


def train(codes: np.ndarray, gold: np.ndarray, units: int = 20, batches: int = 420, size: int = 48, rate: float = 0.02, seed: int = 5) -> Tagger:
    """Fits the tagger to windows (rows, WIDTH) of codes and tags by Adam."""
    rng = np.random.default_rng(seed)
    m = list(blank_tagger(units, seed))
    mean, square = [np.zeros_like(w) for w in m], [np.zeros_like(w) for w in m]
    for k in range(1, batches + 1):
        rows = rng.integers(0, len(codes), size)
        _, grads = gradients(Tagger(*m), codes[rows], gold[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        slow = rate * min(1.0, 2 * (1 - k / (batches + 1)))
        for j, g in enumerate(grads):
            g = (g * min(1.0, 5 / (norm + 1e-9))).astype(np.float32)
            mean[j] = 0.9 * mean[j] + 0.1 * g
            square[j] = 0.99 * square[j] + 0.01 * g * g
            m[j] = (m[j] - slow * (mean[j] / (1 - 0.9**k)) / (np.sqrt(square[j] / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
    return Tagger(*m)


# ---------------------------------------------------------------- labelled spans


def labelled_lines(n: int, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Made-up lines with labelled personal data and secrets, and numbers and codes that are neither."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    number = lambda a, b: int(rng.integers(a, b))
    of = lambda signs, k: "".join(pick(signs) for _ in range(k))
    parts = "an er on th ti re es en in ou la de le is ie ch ge un que ción ung ver mos ra to bl ä pf so ki".split()
    word = lambda: "".join(pick(parts) for _ in range(number(1, 4)))
    letters = "abcdefghijklmnopqrstuvwxyz"

    def card() -> str:
        body = digits(number(13, 16))
        body += next(d for d in "0123456789" if luhn(body + d))
        if len(body) == 15 and rng.random() < 0.5:
            return pick((" ", "-", ".", "  ")).join((body[:4], body[4:10], body[10:]))
        return pick(("", " ", "-", ".", "/", " - ", "  ")).join(re.findall(".{1,4}", body))

    def phone() -> str:
        gap = pick((" ", "-", ".", "/", ""))
        code = number(1, 99)
        return pick(
            (
                f"+{code}{gap or ' '}{digits(3)}{gap}{digits(3)}{gap}{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{code} ({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}",
                f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"0{digits(2)}/{digits(7)}", f"(0{digits(2)}) {digits(4)} {digits(3)}", f"00{code} {digits(3)} {digits(6)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
            )
        )

    def email() -> str:
        name = f"{word()}{pick(('.', '_', '-', '+', ''))}{pick((word(), digits(2)))}"
        at, dot = pick((("@", "."), ("@", "."), (" (at) ", "."), (" [at] ", "."), ("(at)", "."), ("[at]", " [dot] "), (" (at) ", " (dot) "), (" @ ", ".")))
        return f"{name}{at}{word()}{pick(('.', '-')) if dot == '.' else ''}{word()}{dot}{pick(('com', 'org', 'net', 'de', 'es', 'fr'))}"

    def address() -> str:
        return pick((".", ".", "[.]", "(.)", " . ")).join(str(number(0, 256)) for _ in range(4))

    def secret() -> tuple[str, str, str]:
        """What stands before, the secret, and what stands after."""
        value = pick((rng.bytes(number(8, 24)).hex(), of(letters + letters.upper() + "0123456789", number(16, 44)), of(letters + "0123456789", number(12, 30))))
        draw = rng.random()
        if draw < 0.25:
            return "", pick(("AKIA", "ASIA", "ghp_", "sk-", "xoxb-")) + of(letters.upper() + "0123456789", number(14, 24)), ""
        name = pick(("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "API-Key", "access_token", "Passwort", "auth"))
        if draw < 0.6:
            return f"{name}{pick(('=', ': ', ' = ', ':'))}", value, ""
        quote = pick(('"', "'"))
        return f"{name}{pick(('=', ': ', ' = '))}{quote}", value, quote

    makers = {"email": email, "ip": address, "card": card, "phone": phone}
    plain = (
        lambda: f"Version {digits(1)}.{digits(1)}.", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}", lambda: digits(number(1, 7)), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}",
        lambda: f"{digits(2)}.{digits(2)} %", lambda: f"@{word()}", lambda: f"(c) 20{digits(2)} {word()}", lambda: f"{digits(2)},{digits(3)}", lambda: digits(number(20, 40)), lambda: f"{digits(2)}.{digits(2)}.{digits(4)}",
        lambda: f"CC BY-NC {digits(1)}.0.", lambda: f"commit {rng.bytes(20).hex()}", lambda: f"sha256 {rng.bytes(32).hex()}", lambda: f"{of(letters.upper(), 2)}-{digits(4)}", lambda: f"https://{word()}.org/{word()}/{digits(5)}?id={digits(3)}",
        lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"{pick(('password', 'token', 'key'))} {word()}", lambda: f"{word()} (at {digits(2)})", lambda: f"{digits(3)}x{digits(3)}", lambda: f"${digits(3)}.{digits(2)}",
    )
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(number(8, 15)):
            draw, before, after = rng.random(), "", ""
            if draw < 0.16:
                kind = pick(TAGGED)
                if kind == "secret":
                    before, item, after = secret()
                else:
                    item = makers[kind]()
                spans.append((kind, len(text) + len(before), len(text) + len(before) + len(item)))
            elif draw < 0.27:
                item = pick(plain)()
            else:
                item = word()
            text += before + item + after + pick((" ", " ", " ", ", ", ". ", "\n"))
        out.append((text, spans))
    return out


def to_windows(lines: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    codes, gold = [], []
    for text, spans in lines:
        x, y = encode(text), np.zeros(len(text), np.int64)
        for kind, start, end in spans:
            y[start:end] = 2 + 2 * TAGGED.index(kind)
            y[start] -= 1
        for at in range(0, max(1, len(x) - WIDTH // 2), WIDTH // 2):
            pad = max(0, at + WIDTH - len(x))
            codes.append(np.pad(x[at : at + WIDTH], (0, pad)))
            gold.append(np.pad(y[at : at + WIDTH], (0, pad)))
    return np.array(codes), np.array(gold)


LINES = 2500


@lru_cache(maxsize=1)
def _windows() -> tuple[np.ndarray, np.ndarray, str]:
    codes, gold = to_windows(labelled_lines(LINES))
    return codes, gold, hashlib.sha256(codes.tobytes() + gold.tobytes() + repr((train.__defaults__, TAGGED)).encode()).hexdigest()


def packed(tagger: Tagger) -> bytes:
    """The weights as plain arrays."""
    out = BytesIO()
    np.savez(out, **tagger._asdict())
    return out.getvalue()


def unpacked(raw: bytes) -> Tagger:
    """The tagger of ``packed`` weights; what holds anything but arrays is refused."""
    with np.load(BytesIO(raw), allow_pickle=False) as arrays:
        return Tagger(**{name: arrays[name] for name in Tagger._fields})


@lru_cache(maxsize=1)
def production_tagger(spark: SparkSession | None = None) -> Tagger:
    """The tagger used in production: labelled lines from fixed seeds; read from the shared folder if it is there."""
    codes, gold, name = _windows()
    if spark is None:
        return train(codes, gold)
    # In the folder that all applications share, if there is one.
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or checkpoint_root(spark)}/tagger-arrays-{name}"
    try:
        return unpacked(spark.read.schema("weights binary").parquet(path).first()[0])
    except (AnalysisException, TypeError):  # not there, or not written to the end
        tagger = train(codes, gold)
        spark.createDataFrame([(packed(tagger),)], "weights binary").write.mode("overwrite").parquet(path)
        return tagger


# ---------------------------------------------------------------- decoding


def _plausible(kind: str, value: str) -> bool:
    """The least that a span of a kind must hold."""
    digits = sum("0" <= c <= "9" for c in value)
    if kind == "email":
        plain = re.sub(r"\s*(?:[(\[]at[)\]]|@)\s*", "@", value.lower())
        return bool(re.fullmatch(r"[^@\s]+@[^@\s]+(?:\.|\s*[(\[]dot[)\]]\s*)[a-z]+", plain))
    if kind == "ip":
        numbers = re.split(r"\s*(?:\[\.\]|\(\.\)|\.)\s*", value)
        return len(numbers) == 4 and all(p.isascii() and p.isdigit() and int(p) <= 255 for p in numbers)
    if kind == "card":
        plain = re.sub("[ ./-]", "", value)
        return plain.isascii() and plain.isdigit() and 12 <= digits <= 19 and luhn(plain)
    if kind == "secret":
        return len(value) >= 10 and digits > 0 and bool(re.fullmatch(r"[A-Za-z0-9+/_=.-]+", value)) and bool(re.search("[A-Za-z]", value))
    return 9 <= digits <= 15 and not re.search(r"[^0-9+(). /-]", value) and bool(re.search("[-+() ./]", value))


def _whole(kind: str, text: str, start: int, end: int) -> tuple[int, int]:
    """A secret reaches as far as its characters do."""
    if kind == "secret":
        while start and (text[start - 1].isalnum() or text[start - 1] in "_-") and text[start - 1].isascii():
            start -= 1
        while end < len(text) and (text[end].isalnum() or text[end] in "_-") and text[end].isascii():
            end += 1
    return start, end


def windows_at(text: str) -> list[int]:
    """Starts of the overlapping windows that hold what is telling."""
    step, out = WIDTH // 2, set()
    last = max(0, (len(text) - WIDTH + step - 1) // step)
    for m in re.finditer(TELLING, text):
        k = m.start() // step
        out.update(j for j in (k - 1, k) if 0 <= j <= last)
    return sorted(j * step for j in out)


def tag(m: Tagger, texts: list[str]) -> list[list[Span]]:
    """Spans the tagger finds in each text, reconciled over its windows."""
    where = [(k, at) for k, text in enumerate(texts) for at in windows_at(text)]
    votes: list[dict[Span, int]] = [{} for _ in texts]
    for lo in range(0, len(where), 512):
        part = where[lo : lo + 512]
        codes = np.array([np.pad(x, (0, WIDTH - len(x))) for k, at in part for x in (encode(texts[k][at : at + WIDTH]),)])
        paths = best_path(emissions(m, codes), m.moves)
        for (k, at), path in zip(part, paths, strict=True):
            end = min(WIDTH, len(texts[k]) - at)
            j = 0
            while j < end:
                if not path[j]:
                    j += 1
                    continue
                kind, start = (path[j] - 1) // 2, j
                j += 1
                while j < end and path[j] == 2 + 2 * kind:
                    j += 1
                value = texts[k][at + start : at + j]
                left, right = len(value) - len(value.lstrip(" \n.,-")), len(value.rstrip(" \n.,-"))
                whole = (start > 0 or at == 0) + (j < end or at + end == len(texts[k]))
                lo, hi = _whole(TAGGED[kind], texts[k], at + start + left, at + start + right)
                if lo < hi and _plausible(TAGGED[kind], texts[k][lo:hi]):
                    span = (TAGGED[kind], lo, hi)
                    votes[k][span] = max(votes[k].get(span, 0), whole)
    out = []
    for found in votes:
        starts: list[int] = []
        kept: list[Span] = []
        for span in sorted(found, key=lambda s: (-found[s], s[1] - s[2], s[1], s[0])):
            # Kept spans do not overlap, so only the neighbours can be in the way.
            k = bisect(starts, span[1])
            if (not k or kept[k - 1][2] <= span[1]) and (k == len(kept) or span[2] <= kept[k][1]):
                starts.insert(k, span[1])
                kept.insert(k, span)
        out.append(in_order(kept))
    return out


def find(m: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Per text: base spans, and all spans (the tagger's where they touch no base span and no other text character run)."""
    out = []
    for text, tagged in zip(texts, tag(m, texts), strict=True):
        base = base_spans(text)
        taken = np.zeros(len(text) + 1, bool)
        for _, start, end in base:
            taken[start:end] = True
        solid = lambda c: c.isalnum() or c in "@_"
        more = [s for s in tagged if not taken[s[1] : s[2]].any() and not (s[1] and solid(text[s[1] - 1])) and not (s[2] < len(text) and solid(text[s[2]]))]
        out.append((base, in_order(base + more)))
    return out


def detect(docs: DataFrame, keep: list[str | Column], text: str = "text", tagger: Tagger | None = None, redact: bool = False) -> DataFrame:
    """The columns ``keep``, then ``base`` and ``spans`` (arrays of kind, start, end in code points).

    With ``redact`` a column ``redacted`` holds the text with every span replaced by its kind.
    Only texts that hold what is telling leave the JVM: no span can be in the others.
    """
    can = F.col(text).rlike(TELLING)
    body, clean_text = fresh(docs, "_text", "_redacted")
    rows = docs.select(*keep, F.when(can, F.col(text)).alias(body), *([F.col(text).alias(clean_text)] if redact else []))
    shared = docs.sparkSession.sparkContext.broadcast(tagger or production_tagger(docs.sparkSession))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, body, 1 << 20):
            texts = part.column(body).to_pylist()
            some = [k for k, t in enumerate(texts) if t]
            base, spans = [[] for _ in texts], [[] for _ in texts]
            for k, (b, s) in zip(some, find(shared.value, [texts[k] for k in some]), strict=True):
                base[k], spans[k] = b, s
            names = [c for c in part.schema.names if c not in (body, clean_text)]
            columns = [part.column(c) for c in names]
            struct = lambda rows: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row] for row in rows], kind)
            if redact:
                clean = part.column(clean_text).to_pylist()
                for k in some:
                    t, upto, pieces = texts[k], 0, []
                    for name, start, end in spans[k]:
                        if end > upto:
                            pieces += [t[upto : max(start, upto)], f"<{name.upper()}>" if start >= upto else ""]
                            upto = end
                    clean[k] = "".join(pieces) + t[upto:]
                columns, names = [*columns, pa.array(clean, pa.string())], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays([*columns, struct(base), struct(spans)], [*names, "base", "spans"])

    span = ArrayType(StructType().add("kind", "string").add("start", "long").add("end", "long"))
    base_schema = rows.drop(body, clean_text).schema
    schema = (base_schema.add("redacted", "string") if redact else base_schema).add("base", span).add("spans", span)
    return rows.mapInArrow(run, schema)
