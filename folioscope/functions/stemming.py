"""S-11: stemmed, folded tokens: the Porter algorithm of 1980 over folded words.

Words are stemmed once each: the column function stems distinct words of a batch.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_RUN = re.compile(r"[^\W_]+")
_VOWELS = "aeiou"
#: The suffixes of the algorithm's steps 2, 3 and 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    """The number of vowel-consonant sequences."""
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


def _swap(w: str, table: dict[str, str], least: int) -> str:
    for s in sorted((s for s in table if w.endswith(s) and w != s), key=len, reverse=True)[:1]:
        return w[: -len(s)] + table[s] if _measure(w[: -len(s)]) > least else w
    return w


@lru_cache(maxsize=50_000)  # some 15 MB, in each worker
def stem(word: str) -> str:
    """Of the word's bytes in UTF-8, so that what is short, double or a consonant is told as
    where the algorithm runs on bytes; words of under 3 bytes or over 64 stay."""
    raw = word.encode("utf-8", "surrogatepass")
    return word if not 3 <= len(raw) <= 64 else _stem(raw.decode("latin-1")).encode("latin-1").decode("utf-8", "replace")


def _stem(w: str) -> str:
    # A suffix is always shorter than the word.
    if w.endswith("sses") and len(w) > 4 or w.endswith("ies") and len(w) > 3:
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed") and len(w) > 3:
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut + "e" if cut.endswith(("at", "bl", "iz")) else cut[:-1] if _double(cut) and cut[-1] not in "lsz" else cut + "e" if _measure(cut) == 1 and _cvc(cut) else cut
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2, 0), _STEP3, 0)
    for s in _STEP4:
        if w.endswith(s) and w != s:
            head = w[: -len(s)]
            if _measure(head) > 1 and (s != "ion" or head[-1:] in ("s", "t")):
                w = head
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def fold(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def analyze(text: str) -> list[str]:
    return [stem(w) for w in _RUN.findall(fold(text))]


#: Bytes of text whose tokens are Python's objects at once.
SLICE = 1_000_000


def _stemmed(text: pa.Array) -> pa.Array:
    """The tokens of each text.  Python's strings take many times the room of Arrow's, so that
    only those of some texts are there at once, of one text where it is large."""
    kind, out, at = pa.list_(pa.string()), [], 0
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(sizes)
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] - sizes[at] + SLICE, "right")))
        out.append(pa.array([analyze(t or "") for t in text.slice(at, end - at).to_pylist()], kind))
        at = end
    return pa.concat_arrays(out) if out else pa.array([], kind)


@F.arrow_udf(ArrayType(StringType()))
def stemmed_tokens(text: pa.Array) -> pa.Array:
    """An analyzer for ``build_index`` in place of plain tokens."""
    return _stemmed(text)


def snippet(body: str, phrases: list[tuple[tuple[str, ...], bool]], size: int = 12) -> str:
    """B-02: the window of ``size`` tokens that covers the phrases best, with an ellipsis on each
    side that is cut; the text's start if it has none.  A phrase is its tokens, and whether
    the last one may go on.

    A distinct phrase in a window counts 1000, each further place of it 1.  Windows stand
    around what they hold from each place of a phrase on; or begin with the sentence that the
    place is in, which counts 100, and 120 where that is the text's first."""
    spans = [(m.start(), m.end()) for m in _RUN.finditer(body)]
    if not spans:
        return body
    words = [stem(fold(body[a:b])) for a, b in spans]
    n = len(words)

    def here(i: int, tokens: tuple[str, ...], open_ended: bool) -> bool:
        last = i + len(tokens) - 1
        same = last < n and words[i:last] == list(tokens[:-1])
        return same and (words[last].startswith(tokens[-1]) if open_ended else words[last] == tokens[-1])

    places = sorted((i, k, len(t)) for k, (t, p) in enumerate(phrases) if t for i in range(n) if here(i, t, p))
    sentences = [0] + [i for i in range(1, n) if re.search(r"[.:][ \t\n\r]+\Z", body[max(0, spans[i - 1][1]) : spans[i][0]])]

    def held(start: int) -> tuple[int, list[tuple[int, int, int]]]:
        some = [p for p in places if start <= p[0] < start + size]
        distinct = len({k for _, k, _ in some})
        return 1000 * distinct + len(some) - distinct, some

    best, first = 0, 0
    for i, _, _ in places:
        score, some = held(i)
        if score > best:
            spare = size - (some[-1][0] + some[-1][2] - some[0][0])
            # Half of what is left goes before, towards zero where it is too little.
            best, first = score, max(0, min(some[0][0] - int(spare / 2), n - size))
        sentence = max(s for s in sentences if s <= i)
        if sentence < i and n > size:
            score = held(sentence)[0] + (100 if sentence else 120)
            if score > best:
                best, first = score, sentence
    last = min(n, first + size)
    head = "" if first == 0 else "…"
    return head + body[0 if first == 0 else spans[first][0] : len(body) if last == n else spans[last - 1][1]] + ("" if last == n else "…")


def with_snippets(hits, texts: list[str], prefixes: list[bool] | None = None):
    """The hits, a bounded top-k, with a snippet of their body around the phrases of the texts."""
    wanted = [(tuple(analyze(t)), p) for t, p in zip(texts, prefixes or [False] * len(texts), strict=True)]
    make = F.pandas_udf(lambda body: body.map(lambda b: snippet(b or "", wanted)), "string")
    return hits.withColumn("snippet", make("body"))


def ascii_slug(phrase: str | None, longest: int = 60) -> str:
    """S-12: a phrase folded to ASCII, kebab-case, cut at a word's end where there is one."""
    longest = longest if longest > 0 else 60
    folded = unicodedata.normalize("NFKD", phrase or "").encode("ascii", "ignore").decode().lower()
    slug = re.sub("[^a-z0-9]+", "-", folded).strip("-")
    if len(slug) <= longest:
        return slug
    head = slug[: longest + 1].rpartition("-")[0]
    return (head or slug[:longest]).strip("-")


@F.pandas_udf(StringType())
def sanitized_slug(phrase: pd.Series) -> pd.Series:
    return phrase.map(ascii_slug)
