"""Secret scanning: fixed expressions, and a conditional random field that adds to them.

Tokens (runs without white space) are tagged as the begin of a secret, inside one,
or outside, from their shape, the tokens around them and features of the whole
text; Viterbi decodes the tags.  The field is trained here, on texts drawn by a
fixed generator (`TRAINING` of them), so it is the same in every run; what it finds
next to the expressions' matches is added as spans of kind `crf`.

All tokens are decoded, those of letters alone too: each gets its scores, and Viterbi
walks where a secret is possible at all (`Decoder`); `c.viterbi` on all rows gives the same.

Defined results: a null text is empty; texts of any length are scanned whole, one
at a time; repeated rows give their rows again; an empty table gives an empty
result; columns other than the key and the text are not used.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import crf
from graphloom.llm.common import map_rows, own_id, safe_id
from graphloom.llm.spans import Span, digest, matches, overlapped, written

BASE = {
    "assign": ("", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[1]) >= 12),
    "access": ("AKIA", re.compile(r"AKIA[A-Z0-9]{14,}"), bool),  # shorter runs fail, and hold no longer one
    "hex": ("", re.compile(r"[0-9a-f]{16,}"), bool),
}
KINDS = [*BASE, "crf"]
OUT, BEGIN, INSIDE = 0, 1, 2
TRAINING = 800

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_CUE = re.compile(r"pass(?:word|wd)?|secret|token|key|bearer|auth|credential|signature", re.I)
_STRIP = "\"'`.,;:!?()[]{}<>#$%&*|"

FEATURES = (
    "bias", "short", "middle", "long", "longer", "lower", "upper", "digit", "mixed", "three_classes", "b64_marks", "dense", "hex", "prefix",
    "cue", "ends_assign", "is_assign", "inner_assign", "quoted", "dotted", "mail", "grouped_digits", "url_login", "words_only",
    "letters_joined", "case_turns", "after_cue", "after_assign", "after_cue_assign", "cue_before_two", "before_assign", "text_has_cue", "text_has_assign",
)
_AT = {n: i for i, n in enumerate(FEATURES)}
_SIZES = [_AT[n] for n in ("short", "middle", "long", "longer")]
_TURN = re.compile(r"[a-z][A-Z]")


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def shape(token: str) -> tuple[int, ...]:
    """Indexes of the features of a token by itself."""
    core = token.strip(_STRIP)
    n = len(core)
    if core.isalpha():  # the same features, without the expressions that need more than letters
        if core.islower() and core.isascii():
            low, up, turns = True, False, False
        else:
            low, up = any(map(str.islower, core)), any(map(str.isupper, core))
            turns = low and up and len(_TURN.findall(core)) >= 2
        out = [0, _SIZES[0] if n < 6 else _SIZES[1] if n < 12 else _SIZES[2] if n < 24 else _SIZES[3]]
        if low:
            out.append(_AT["lower"])
        if up:
            out.append(_AT["upper"])
        if n > 2 and _CUE.search(core):
            out.append(_AT["cue"])
        if token[-1] in "=:\"'" and token.rstrip("\"'")[-1:] in ("=", ":"):
            out.append(_AT["ends_assign"])
        if token[0] in "\"'`":
            out.append(_AT["quoted"])
        if turns:
            out.append(_AT["case_turns"])
        return (*out, _AT["words_only"])
    lower, upper, digit = (any(f(c) for c in core) for f in (str.islower, str.isupper, str.isdigit))
    value = re.split(r"[=:]", core)[-1].strip(_STRIP) or core
    has = {
        "bias": True,
        "short": n < 6,
        "middle": 6 <= n < 12,
        "long": 12 <= n < 24,
        "longer": n >= 24,
        "lower": lower,
        "upper": upper,
        "digit": digit,
        "mixed": digit and (lower or upper),
        "three_classes": digit and lower and upper,
        "b64_marks": digit and bool(re.search(r"[+/_=-]", value)),
        "dense": digit and len(value) >= 12 and (lower or upper) and _entropy(value) >= 3.0,
        "hex": digit and len(value) >= 16 and bool(re.fullmatch(r"[0-9a-fA-F]+", value)),
        "prefix": digit and bool(re.match(r"(?:AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abp]-|eyJ|glpat-|AIza)", value)),
        "cue": bool(_CUE.search(core)),
        "ends_assign": token.rstrip("\"'")[-1:] in ("=", ":"),
        "is_assign": token in ("=", ":", ":=", "=>"),
        "inner_assign": bool(re.search(r"[^=:][=:][^=:/]", core)),
        "quoted": token[:1] in "\"'`",
        "dotted": bool(re.fullmatch(r"[\w-]+(?:\.[\w-]+)+", core)),
        "mail": "@" in core and "://" not in core,
        "grouped_digits": bool(re.fullmatch(r"[+(]?[0-9][0-9 ().,:/-]*", core)),
        "url_login": bool(re.search(r"://[^/\s:@]+:[^/\s:@]+@", core)),
        "letters_joined": not digit and bool(re.search(r"[^\W_][-!.@#$%^&*+/_=][^\W_]", value)),
        "case_turns": not digit and len(re.findall(r"[a-z][A-Z]", value)) >= 2,
        "words_only": not digit and not re.search(r"[=:_+/]", core),
    }
    return tuple(_AT[k] for k, v in has.items() if v)


def rows(tokens: list[str], has_cue: bool, has_assign: bool) -> np.ndarray:
    """Features of tokens that stand next to each other; the two outer ones on either side only lend theirs."""
    x = np.zeros((len(tokens), len(FEATURES)))
    for i, t in enumerate(tokens):
        x[i, list(shape(t))] = 1
        one, two = tokens[i - 1] if i else "", tokens[i - 2] if i > 1 else ""
        cue, assign = bool(_CUE.search(one)), one.rstrip("\"'")[-1:] in ("=", ":")
        x[i, _AT["after_cue"]] = cue
        x[i, _AT["after_assign"]] = assign
        x[i, _AT["after_cue_assign"]] = assign and (cue or bool(_CUE.search(two)))
        x[i, _AT["cue_before_two"]] = bool(_CUE.search(two))
        x[i, _AT["before_assign"]] = i + 1 < len(tokens) and tokens[i + 1][:1] in ("=", ":")
        x[i, _AT["text_has_cue"]] = has_cue
        x[i, _AT["text_has_assign"]] = has_assign
    return x


# --- training texts -------------------------------------------------------

_SYLLABLES = "an er on th re in es ou ti ed en at st nd or ha he sh nt ing ion ble ver ung lich keit ment eau que ción ado mente ß ä é".split()
_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_ALNUM = _B64[:62]
_LETTERS = _B64[:52]


def _word(r: random.Random) -> str:
    w = "".join(r.choices(_SYLLABLES, k=r.randint(1, 4)))
    w = w.upper() if (u := r.random()) < 0.05 else w.capitalize() if u < 0.15 else w
    return w + r.choices(["", ",", ".", "!!", "###", "%%%", "$$$", ":"], [80, 6, 8, 2, 2, 2, 2, 1])[0]


def _harmless(r: random.Random) -> str:
    d = lambda n: "".join(r.choices("0123456789", k=n))
    return r.choice([
        d(r.randint(1, 6)), d(16), f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"{d(3)}.{d(2)}.{d(2)}.{d(3)}", f"{d(2)}@mail{d(1)}.example.com",
        f"+1 ({d(3)}) 555-{d(4)}", f"http://www.example.com/{_word(r)}/{d(3)}", f"v{d(1)}.{d(1)}", f"{_word(r)}_{_word(r)}", f"{d(2)}%", f"a={d(1)}", f"{_word(r)}/{_word(r)}", "|", "=", f"{_word(r)}{d(2)}", f"Version {d(1)}.0.",
    ])


def _phrase(r: random.Random) -> str:
    """A pass phrase of letters: words joined by marks."""
    words = ["".join(r.choices(_SYLLABLES, k=r.randint(2, 4))) for _ in range(r.randint(3, 5))]
    return "".join(w + (r.choice("-!.") if i + 1 < len(words) else "") for i, w in enumerate(w.capitalize() if r.random() < 0.3 else w for w in words))


def _secret(r: random.Random) -> list[tuple[str, int]]:
    """Tokens and tags of a phrase with a secret."""
    k = lambda a, lo, hi: "".join(r.choices(a, k=r.randint(lo, hi)))
    value = r.choice([lambda: k(_ALNUM, 20, 40), lambda: k("0123456789abcdef", 32, 40), lambda: k(_B64, 24, 60) + "=", lambda: "ghp_" + k(_ALNUM, 36, 36), lambda: "sk-" + k(_ALNUM, 32, 48), lambda: "AKIA" + k("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), lambda: k(_ALNUM, 12, 16) + "!" + k("0123456789", 2, 4), lambda: k(_LETTERS, 16, 40), lambda: _phrase(r)])()
    q = r.choice(["", '"', "'"])
    cue = r.choice(["password", "secret", "token", "api_key", "Authorization", "credentials", "client_secret", "access_key", "signature"])
    form = r.randrange(7)
    if form == 0:
        return [(cue, OUT), (r.choice("=:"), OUT), (q + value + q, BEGIN)]
    if form == 1:
        return [(cue + r.choice("=:"), OUT), (q + value + q, BEGIN)]
    if form == 2:
        return [(f"{cue}={q}{value}{q}", BEGIN)]
    if form == 3:
        return [("Authorization:", OUT), ("Bearer", OUT), (value, BEGIN)]
    if form == 4:
        return [(f"postgres://{_word(r).strip('.,')}:{k(_ALNUM, 10, 16)}@db.example.com/x", BEGIN)]
    if form == 5:
        return [(cue, OUT), (r.choice(["is", "was", "ist", "es"]), OUT), (q + value + q, BEGIN)]
    half = [value[i : i + 12] for i in range(0, len(value), 12)]
    return [(cue + ":", OUT), *[(h, INSIDE if i else BEGIN) for i, h in enumerate(half)]]


def training_texts(n: int = TRAINING, seed: int = 11) -> list[list[tuple[str, int]]]:
    r, out = random.Random(seed), []
    for _ in range(n):
        seq: list[tuple[str, int]] = []
        loud = r.random() < 0.15  # a text in capitals, each word with the same marks
        mark = r.choice(["", "!!", "###", "!!!", "$$$"])
        for _ in range(r.randint(4, 14)):
            u = r.random()
            if u < 0.07:
                seq += _secret(r)
            elif u < 0.2:
                seq += [(x, OUT) for x in _harmless(r).split()]
            elif u < 0.23:
                seq += [(r.choice(["the", "a", "your"]), OUT), (r.choice(["token", "password", "key", "secret"]), OUT), (_word(r), OUT)]
            elif u < 0.25:
                seq += [(r.choice(["token", "password:", "key:", "secret", "Authorization:"]), OUT), (r.choice(["is", "for", "not", "=", "the"]), OUT), (_word(r), OUT), (_word(r), OUT)]
            elif u < 0.27:
                seq.append(("-".join(_word(r).strip(".,!#%$:") for _ in range(r.randint(2, 3))), OUT))
            else:
                seq.append((_word(r).rstrip(".,!#%$:").upper() + mark if loud else _word(r), OUT))
        out.append(seq)
    return out


def train(texts: list[list[tuple[str, int]]]) -> crf.Chain:
    t = max(map(len, texts))
    x, y, mask = np.zeros((len(texts), t, len(FEATURES))), np.zeros((len(texts), t), int), np.zeros((len(texts), t))
    for i, seq in enumerate(texts):
        tokens = [a for a, _ in seq]
        x[i, : len(seq)] = rows(tokens, any(map(_CUE.search, tokens)), any("=" in a or ":" in a for a in tokens))
        y[i, : len(seq)] = [b for _, b in seq]
        mask[i, : len(seq)] = 1
    c = crf.fit(x, y, mask, 3, rounds=100)
    c.move[OUT, INSIDE] = c.first[INSIDE] = -1e3  # a secret does not start inside
    return c


@functools.cache
def model() -> crf.Chain:
    return train(training_texts())


_FLAGS = ("after_cue", "after_assign", "after_cue_assign", "cue_before_two", "before_assign")
#: Different tokens whose scores a worker keeps; the table is emptied when full.
MOST_TOKENS = 300_000


class Decoder:
    """The tags of `c.viterbi(rows(...))`, found without walking over every token.

    The scores of a token by itself are rows of a table, those of its surroundings
    another table over five flags, so a text's scores are two look-ups in numpy.  A
    run of secret tags is worth at most the sum of what its tokens gain over OUTSIDE
    plus the largest gain of a transition for each and one more.  Tokens in no run
    for which that is above zero are OUTSIDE in the best path, whatever stands
    around; Viterbi decides the stretches between them, with OUTSIDE at either end.
    """

    def __init__(self, c: crf.Chain):
        self.c = c
        self.index: dict[bytes, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.scores, self.flags = np.zeros((1024, 3)), np.zeros(1024, np.int64)
        whole = [u * c.emit[_AT["text_has_cue"]] + v * c.emit[_AT["text_has_assign"]] for v in (0, 1) for u in (0, 1)]
        self.near = [np.array([w + sum((c.emit[_AT[f]] for i, f in enumerate(_FLAGS) if k >> i & 1), np.zeros(3)) for k in range(32)]) for w in whole]
        calm = c.move[OUT, OUT]
        self.gain = max(0.0, float((c.move - calm).max()), float((c.first - c.first[OUT]).max()), float((c.last - c.last[OUT]).max()))

    def _row(self, token: bytes) -> int:
        """The row of a token's features: few rows, as many tokens have the same."""
        if len(self.index) >= MOST_TOKENS:
            raise OverflowError
        t = token.decode("utf-8", "surrogatepass")
        at = shape(t)
        key = (t[:1] in ("=", ":"), *at)
        k = self.kinds.get(key)
        if k is None:
            k = self.kinds[key] = len(self.kinds)
            if k == len(self.flags):
                self.scores, self.flags = np.concatenate([self.scores, np.zeros_like(self.scores)]), np.concatenate([self.flags, np.zeros_like(self.flags)])
            self.scores[k] = self.c.emit[list(at)].sum(axis=0)
            self.flags[k] = (_CUE.search(t) is not None) + 2 * (t.rstrip("\"'")[-1:] in ("=", ":")) + 16 * (t[:1] in ("=", ":"))
        self.index[token] = k
        return k

    def rows(self, tokens: list[bytes]) -> np.ndarray:
        get = self.index.get
        at = list(map(get, tokens))
        if None in at:
            try:
                at = [self._row(tokens[i]) if (x := get(tokens[i])) is None else x for i in range(len(tokens))]
            except OverflowError:
                self.index.clear()
                if len(set(tokens)) > MOST_TOKENS:  # one text with more: in parts that fit
                    raise
                at = [self._row(t) if (x := get(t)) is None else x for t in tokens]
        return np.array(at)

    def emissions(self, tokens: list[bytes], has_assign: bool) -> np.ndarray:
        """Scores (tokens x tags) of a whole text."""
        if len(tokens) > MOST_TOKENS:
            parts = [(e, f) for i in range(0, len(tokens), MOST_TOKENS) for e, f in [self._own(tokens[i : i + MOST_TOKENS])]]
            e, f = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        else:
            e, f = self._own(tokens)
        cue, assign = np.zeros(len(f) + 2, np.int64), np.zeros(len(f) + 2, np.int64)
        cue[2:], assign[2:] = f & 1, f >> 1 & 1
        one, two, eq = cue[1:-1], cue[:-2], assign[1:-1]
        k = one + 2 * eq + 4 * (eq & (one | two)) + 8 * two
        k[:-1] += f[1:] & 16
        return e + self.near[2 * has_assign + bool(cue.any())][k]

    def _own(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = self.rows(tokens)
        return self.scores[at], self.flags[at]

    def secrets(self, tokens: list[bytes], has_assign: bool) -> list[tuple[int, int]]:
        """(first, last) token of each secret."""
        x = self.emissions(tokens, has_assign)
        up = np.maximum(x[:, 1], x[:, 2]) - x[:, 0] + self.gain
        if up.max() + self.gain <= 0:
            return []
        p = np.concatenate([[0.0], np.cumsum(up)])
        least, most = np.minimum.accumulate(p[:-1]), np.maximum.accumulate(p[:0:-1])[::-1]
        maybe = np.flatnonzero(most - least + self.gain > -1e-9)
        out: list[list[int]] = []
        for run in np.split(maybe, np.flatnonzero(np.diff(maybe) > 1) + 1):
            if not len(run):
                continue
            s, e = int(run[0]), int(run[-1]) + 1
            for t, tag in enumerate(self.walk(x[s:e].tolist(), s == 0, e == len(x)), s):
                if tag == BEGIN or tag == INSIDE and not out:
                    out.append([t, t])
                elif tag == INSIDE:
                    out[-1][1] = t
        return [tuple(x) for x in out]

    def walk(self, rows: list[list[float]], at_start: bool, at_end: bool) -> list[int]:
        """Viterbi over a stretch, OUTSIDE before and after it or the text's ends."""
        c = self.c
        ((m00, m01, m02), (m10, m11, m12), (m20, m21, m22)) = c.move.tolist()
        (f0, f1, f2), last = (c.first if at_start else c.move[OUT]).tolist(), (c.last if at_end else c.move[:, OUT]).tolist()
        e0, e1, e2 = rows[0]
        s0, s1, s2 = f0 + e0, f1 + e1, f2 + e2
        back = []
        for e0, e1, e2 in rows[1:]:
            b0 = b1 = b2 = 0
            x0, x1, x2 = s0 + m00, s0 + m01, s0 + m02
            if (y := s1 + m10) > x0:
                x0, b0 = y, 1
            if (y := s2 + m20) > x0:
                x0, b0 = y, 2
            if (y := s1 + m11) > x1:
                x1, b1 = y, 1
            if (y := s2 + m21) > x1:
                x1, b1 = y, 2
            if (y := s1 + m12) > x2:
                x2, b2 = y, 1
            if (y := s2 + m22) > x2:
                x2, b2 = y, 2
            back.append((b0, b1, b2))
            s0, s1, s2 = x0 + e0, x1 + e1, x2 + e2
        end = [s + x for s, x in zip((s0, s1, s2), last)]
        tag = end.index(max(end))
        tags = [tag]
        for b in reversed(back):
            tag = b[tag]
            tags.append(tag)
        return tags[::-1]


def tagged(text: str, c: crf.Chain, skip_plain: bool = True) -> list[tuple[int, int]]:
    """Spans of the secrets that the chain finds in a text; without `skip_plain` by the rows of all features."""
    has_assign = "=" in text or ":" in text
    tokens = text.encode("utf-8", "surrogatepass").split()  # of bytes: ASCII white space alone divides
    if not tokens:
        return []
    if skip_plain:
        if "decoder" not in c.__dict__:
            c.__dict__["decoder"] = Decoder(c)
        runs = c.__dict__["decoder"].secrets(tokens, has_assign)
        if not runs:
            return []
        spots = [m.span() for m in _TOKEN.finditer(text)]
    else:
        spots = [m.span() for m in _TOKEN.finditer(text)]
        tags = c.viterbi(rows([text[s:e] for s, e in spots], _CUE.search(text) is not None, has_assign))
        runs = []
        for t, tag in enumerate(tags):
            if tag == BEGIN or tag == INSIDE and not runs:
                runs.append([t, t])
            elif tag == INSIDE:
                runs[-1][1] = t
    trimmed = []
    for s, e in ((spots[a][0], spots[b][1]) for a, b in runs):
        piece = text[s:e]
        s, e = s + len(piece) - len(piece.lstrip(_STRIP)), e - len(piece) + len(piece.rstrip(_STRIP))
        if s < e:
            trimmed.append((s, e))
    return trimmed


def find(text: str, c: crf.Chain) -> tuple[list[Span], list[Span]]:
    """Spans of the expressions, and those that the chain adds."""
    base = matches(text, BASE)
    return base, [("crf", s, e) for s, e in tagged(text, c) if not overlapped(s, e, base)]


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its counts and spans; one pass, no shuffle."""
    c = model()

    def make():
        def look(i: int, t: str | None) -> Iterator[tuple]:
            base, more = find(t or "", c)
            n = Counter(k for k, _, _ in base)
            yield i, n["assign"], n["access"], n["hex"], digest(base, KINDS), written(base + more, KINDS), len(more)

        return look

    d = map_rows(df.select(safe_id(F.col(key)).alias("doc_id"), F.col(text).alias("text")), make, RESULT)
    return d.withColumn("doc_id", own_id(F.col("doc_id"))).withColumnRenamed("doc_id", key)
