"""Text functions as column expressions; Arrow UDFs only where no built-in can express them.

Each tokeniser here has rules of its own, on purpose: they are different functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .hashing import fnv1a

#: Words that the overlap signal ignores.
SCORER_STOP = sorted(
    "their them they its it those these that this must might may should could would will did does do had has have being been were was be are is from by with of for to at on in but or and an a the".split()
)
#: Words that keyword extraction ignores.
KEYWORD_STOP = sorted("so than then if as an a those these that this can might may should could would will did does do had has have been be were was are is by with of for to at on in but or and the".split())
#: Words that the Jaccard measure ignores.
JACCARD_STOP = sorted(
    "false true yes no not once further again under over out down up there here then now also just very too than so same own only such some most more few both every each all how why where when who which what "
    "them they its it those these that this can must might may should could would will did does do had has have be been are was is as from by with of for to at on in but or and an a the".split()
)
WORD = r"[\p{L}\p{N}]+"
KEYWORD_TRIM = ".,!?;:\"'()[]{}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _words(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def normalize_text(text: Column | str) -> Column:
    """One leading byte-order mark goes; CRLF and CR become LF."""
    return F.regexp_replace(F.regexp_replace(_col(text), "^﻿", ""), "\r\n?", "\n")


def collapse(text: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(text), r"[\s\p{Z}\x{85}]+", " "))


def overlap_tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and numbers of more than two BYTES that aren't stop words."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))
    stop = _words(SCORER_STOP)
    return F.filter(found, lambda t: (F.octet_length(t) > 2) & ~F.array_contains(stop, t))


def overlap_ratio(tokens: Column, reference: Column) -> Column:
    """The share of `tokens`, repeats included, that occur in `reference`; 0 if either is empty."""
    hits = F.size(F.filter(tokens, lambda t: F.array_contains(reference, t)))
    return F.when((F.size(tokens) > 0) & (F.size(reference) > 0), hits / F.size(tokens)).otherwise(0.0)


def keyword_overlap(query: Column | str, content: Column | str) -> Column:
    return overlap_ratio(overlap_tokens(query), overlap_tokens(content))


def filename_overlap(filename: Column | str, name: Column | str) -> Column:
    """As keyword_overlap, but what is divided by is the number of tokens of the FILENAME."""
    return overlap_ratio(overlap_tokens(filename), overlap_tokens(name))


def analyze(text: Column | str, min_length: int = 1, stop: Sequence[str] = ()) -> Column:
    """Lexical analyser: lower-case runs of letters and numbers of at least min_length characters, without stop words."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))
    if min_length <= 1 and not stop:
        return found
    return F.filter(found, lambda t: (F.char_length(t) >= min_length) & (~F.array_contains(_words(list(stop)), t) if stop else F.lit(True)))


def analyze_with_offsets(text: Column | str) -> Column:
    """Tokens with byte offsets into the text and their positions."""
    import regex

    pattern = regex.compile(WORD)

    def one(t):
        if t is None:
            return None
        out, at, byte = [], 0, 0
        for i, m in enumerate(pattern.finditer(t)):
            byte += len(t[at : m.start()].encode())
            size = len(m[0].encode())
            out.append({"text": "".join(c.lower()[:1] if len(c.lower()) != 1 else c.lower() for c in m[0]), "start": byte, "end": byte + size, "position": i})
            at, byte = m.end(), byte + size
        return out

    @pandas_udf("array<struct<text:string,start:int,end:int,position:int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(_col(text))


def phrase_terms(text: Column | str, stop: Sequence[str] = ()) -> Column:
    """Runs of letters and decimal digits of at least two characters, without stop words."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    return F.filter(found, lambda t: (F.char_length(t) >= 2) & (~F.array_contains(_words(list(stop)), t) if stop else F.lit(True)))


def text_terms(text: Column | str) -> Column:
    """Distinct runs of letters and decimal digits of at least four characters."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.char_length(t) >= 4))


def keyword_tokens(text: Column | str, min_length: int = 4, extra_stop: Sequence[str] = ()) -> Column:
    """White-space tokens of the lower-case text, punctuation trimmed off, long enough and no stop words."""
    stop = _words(sorted({*KEYWORD_STOP, *(s.lower() for s in extra_stop)}))
    parts = F.transform(F.split(F.lower(_col(text)), r"\s+"), lambda t: F.btrim(t, F.lit(KEYWORD_TRIM)))
    return F.filter(parts, lambda t: (F.char_length(t) >= min_length) & ~F.array_contains(stop, t))


def near_term(term: Column, candidate: Column, by_bytes: bool = False) -> Column:
    """Whether a candidate of seven characters or more lies within an edit distance of 1 of the term, 2 if the TERM has ten or more.

    One trailing s is dropped from each. Shorter terms match nothing, not even themselves; so the rule is a directed one.
    by_bytes: edits are of the words' UTF-8 bytes, as DuckDB counts them, and not of characters; lengths still are of characters.
    """
    x, y = F.regexp_replace(F.lower(_col(term)), "s$", ""), F.regexp_replace(_col(candidate), "s$", "")
    size = F.char_length(x)
    unit = (lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")) if by_bytes else (lambda c: c)  # a character for each byte
    return (size >= 7) & (F.char_length(y) >= 7) & (F.levenshtein(unit(x), unit(y)) <= F.when(size >= 10, 2).otherwise(1))


def _winkler(a: str, b: str) -> float:
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    seen = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not seen[j] and b[j] == c:
                seen[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, s in zip(b, seen) if s]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    """Jaro-Winkler similarity regardless of case; two empty strings are equal."""

    @pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _winkler(x, y) for x, y in zip(a, b)], dtype=float)

    return run(_col(a), _col(b))


def _fuzzy(a: str, b: str) -> bool:
    """Different words of four characters or more whose lengths differ by 1 at most (2 from ten characters on) and that are similar."""
    short, long = sorted((len(a), len(b)))
    return a != b and short >= 4 and long - short <= (2 if short >= 10 else 1) and _winkler(a, b) >= 0.88


def _matched(query: list[str], target: list[str]) -> tuple[int, bool]:
    """(how many target words find a query word of their own, whether any of them only by similarity); equal words go first."""
    free, open_ = list(range(len(query))), []
    for word in target:
        same = next((j for j in free if query[j] == word), None)
        if same is None:
            open_.append(word)
        else:
            free.remove(same)
    near = [[j for j in free if _fuzzy(query[j], word)] for word in open_]
    owner: dict[int, int] = {}

    def place(k: int, tried: set[int]) -> bool:
        for j in near[k]:
            if j not in tried:
                tried.add(j)
                if j not in owner or place(owner[j], tried):
                    owner[j] = k
                    return True
        return False

    fuzzy = sum(place(k, set()) for k in range(len(open_)))
    return len(target) - len(open_) + fuzzy, fuzzy > 0


def _named(q: list[str], p: list[str]) -> tuple[float, str]:
    if not q or not p:
        return 0.0, ""
    if q == p:
        return 1.0, "exact_phrase"
    if any(q[j : j + len(p)] == p for j in range(len(q) - len(p) + 1)):
        return 0.96, "alias_phrase"
    found = (0.0, "")
    if len(p) == 1:
        found = max([(_winkler(t, p[0]), "fuzzy_token") for t in q if _fuzzy(t, p[0])], default=found, key=lambda f: f[0])
    hits, fuzzy = _matched(q, p)
    if hits / len(p) > found[0]:
        found = (hits / len(p), "fuzzy_token" if fuzzy else "token_coverage")
    if found[0] < 0.84 and len(q) >= 2 and len(p) >= 3 and _matched(q, [p[0], p[-1]])[0] == 2:
        found = (0.84, "token_coverage")
    return found


def _alias(query: str, phrases: list[str], stop: frozenset[str] = frozenset()) -> tuple[float, str]:
    """How well a query names something: best over its phrase (the first) and aliases; the first of equally good ones counts."""
    import regex

    terms = lambda s: [t for t in regex.findall(r"[\p{L}\p{Nd}]+", s.lower()) if len(t) >= 2 and t not in stop]
    q, best = terms(query), (0.0, "")
    for i, phrase in enumerate(phrases):
        found = _named(q, terms(phrase or ""))
        if found[0] > best[0]:
            best = (found[0], "alias_phrase") if i and found[1] == "exact_phrase" else found
    return best


def alias_score(query: Column | str, phrases: Column | str, stop: Sequence[str] = ()) -> Column:
    """Score and reason of the best of a phrase and its aliases (an array, the phrase first) for each query; equal pairs are scored once."""
    ignored = frozenset(stop)

    @pandas_udf("struct<score:double,reason:string>")
    def run(query: pd.Series, phrases: pd.Series) -> pd.DataFrame:
        known: dict[tuple, tuple[float, str]] = {}
        keys = [(q or "", tuple(p) if p is not None else ()) for q, p in zip(query, phrases)]
        for k in dict.fromkeys(keys):
            known[k] = _alias(k[0], list(k[1]), ignored)
        return pd.DataFrame([known[k] for k in keys], columns=["score", "reason"])

    return run(_col(query), _col(phrases))


def line_number(text: Column | str, offset: Column | int) -> Column:
    """The line, from 1, of a byte offset."""
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    head = F.decode(F.substring(F.encode(_col(text), "UTF-8"), F.lit(1), offset.cast("int")), "UTF-8")
    return F.char_length(head) - F.char_length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def title_words(text: Column | str) -> Column:
    """Underscores and hyphens become spaces; each word gets a capital."""
    return F.initcap(collapse(F.regexp_replace(F.lower(_col(text)), "[_-]", " ")))


def _headed(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x))


def metadata(path: Column | str, text: Column | str) -> Column:
    """struct<title, headings>: the title is the file's stem unless a `title:` line names another; headings are the # lines."""
    lines = _headed(_col(text))
    named = F.filter(lines, lambda x: x.startswith("title:") | x.startswith("Title:"))
    last = F.element_at(named, -1)
    given = F.btrim(F.trim(F.regexp_replace(last, "^[Tt]itle:", "")), F.lit("\\\"'"))
    stem = F.regexp_replace(F.regexp_extract(_col(path), r"([^/]*)$", 1), r"\.[^.]*$", "")
    heads = F.filter(F.transform(F.filter(lines, lambda x: x.startswith("#")), lambda x: F.trim(F.regexp_replace(x, "^#+", ""))), lambda x: x != "")
    return F.struct(F.when(F.size(named) > 0, given).otherwise(stem).alias("title"), heads.alias("headings"))


def metadata_terms(text: Column | str) -> Column:
    """Distinct lower-case runs of letters and numbers of at least two bytes; stop words count."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.octet_length(t) >= 2))


def metadata_score(query: Column | str, title: Column, headings: Column, path: Column) -> Column:
    """The best overlap of the query's terms with the title, the headings (0.85) and the file's name (0.65)."""
    q = metadata_terms(query)
    share = lambda text: F.size(F.array_intersect(q, metadata_terms(text))) / F.size(q)
    base = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.when(F.size(q) > 0, F.greatest(share(title), share(F.array_join(headings, " ")) * 0.85, share(base) * 0.65)).otherwise(0.0)


def simple_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(_col(text), 256), 1, 16)


def normalized_hash(text: Column | str) -> Column:
    """Equal for texts that differ in case and white space only."""
    return simple_hash(collapse(F.lower(_col(text))))


def structural_hash(text: Column | str) -> Column:
    """Hash of the tagged, non-blank lines: headings, list items, fences and prose."""
    lines = F.filter(F.transform(F.split(_col(text), "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))), lambda x: x != "")

    def tag(x: Column) -> Column:
        return (
            F.when(x.startswith("#"), F.concat(F.lit("HEADER:"), x))
            .when(x.startswith("-") | x.startswith("*"), F.concat(F.lit("LIST:"), F.btrim(F.substring(x, F.lit(2), F.char_length(x)), F.lit(" \t\r\x0b\x0c"))))
            .when(x.startswith("```"), F.lit("CODE_BLOCK"))
            .otherwise(F.concat(F.lit("TEXT:"), collapse(F.lower(x))))
        )

    return simple_hash(F.array_join(F.transform(lines, tag), "|"))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """1 for the code points of letters, numbers and marks, 2 for white space, else 0."""
    import unicodedata

    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LNM":
            out[c] = 1
        elif chr(c).isspace():
            out[c] = 2
    return out


_OFFSET, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def _gram_hashes(cp: np.ndarray, n: int) -> np.ndarray:
    """FNV-1a-64 of the UTF-8 bytes of the n-grams that start at each code point."""
    m = len(cp) - n + 1
    h = np.full(m, _OFFSET)
    for k in range(n):
        c = cp[k : k + m].astype(np.uint64)
        size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint64)[size]
        for j in range(int(size.max(initial=1))):
            some = size > j
            shift = (6 * (size - 1 - j).clip(0)).astype(np.uint64)
            byte = ((c >> shift) & np.uint64(0x3F)) | np.uint64(0x80) if j else np.where(size == 1, c, lead | (c >> shift))
            h = np.where(some, (h ^ byte) * _PRIME, h)
    return h


def _simhash(text: str, n: int, bits: int) -> int:
    low = text.lower()
    cp = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[cp]
    # white space after white space goes, also where only characters that count for nothing lie between; so does that at the ends
    kept, kind = cp[kind > 0], kind[kind > 0]
    blank = kind == 2
    kept = np.where(blank, 32, kept)
    one = ~blank
    one[1:] |= blank[1:] & ~blank[:-1]
    one[:1] |= blank[:1]
    kept = kept[one]
    kept = kept[int(len(kept) > 0 and kept[0] == 32) : len(kept) - int(len(kept) > 1 and kept[-1] == 32)]
    if len(kept) >= n:
        h = _gram_hashes(kept, n)[(kept[: len(kept) - n + 1] != 32) & (kept[n - 1 :] != 32)]
    else:
        h = np.zeros(0, np.uint64)
    if not len(h):
        if not len(kept) and not text.strip():
            return 0
        h = fnv1a([("\0raw:" + low if not len(kept) else kept.tobytes().decode("utf-32-le", "surrogatepass")).encode("utf-8", "surrogatepass")])
    h, count = np.unique(h, return_counts=True)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # so that a long text takes no more than 64 columns of a part
        on = np.unpackbits(h[i : i + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").astype(np.int64)
        total += count[i : i + (1 << 16)] @ (2 * on - 1)
    return int(sum(1 << int(i) for i in np.flatnonzero(total[:bits] > 0)))


def simhash(text: Column | str, n: int = 3, bits: int = 64) -> Column:
    """SimHash over character n-grams as 16 hex digits; equal texts of a batch are hashed once."""
    n, bits = max(1, n), min(64, max(1, bits))

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = {t: f"{_simhash(t, n, bits):016x}" for t in dict.fromkeys(s) if t is not None}
        return s.map(lambda t: None if t is None else known[t])

    return run(_col(text))


def hex_distance(a: Column, b: Column) -> Column:
    """Hamming distance of two hex hashes; null for ones that can't be read or differ in length."""
    ok = a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$") & (F.char_length(a) == F.char_length(b))
    num = lambda c: F.conv(c, 16, -10).cast("bigint")
    return F.when(ok, F.bit_count(num(a).bitwiseXOR(num(b))))


def jaccard_words(text: Column | str) -> Column:
    """The set of meaningful words that jaccard() compares: no fenced or tilde blocks, no URLs (up to their first s), no stop words, no numbers."""
    t = F.regexp_replace(_col(text), r"(?s)```[\s\S]*?```", " ")
    t = F.regexp_replace(t, r"(?s)~.*?~", " ")
    t = F.regexp_replace(t, r"https?://[^\\s]+", "")
    found = F.transform(F.regexp_extract_all(t, F.lit("[a-zA-Z0-9]{2,}"), F.lit(0)), lambda w: F.lower(w))
    return F.array_distinct(F.filter(found, lambda w: ~F.array_contains(_words(JACCARD_STOP), w) & ~w.rlike("^[0-9]+$")))


def jaccard(a: Column, b: Column) -> Column:
    """|A and B| / |A or B| of two word sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(0.0)


def framed_identity(*fields: Column) -> Column:
    """SHA-256 of length-framed fields, so that no two lists of fields collide by concatenation."""
    return F.sha2(F.concat(*(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f) for f in fields)), 256)


def model_identity(provider: str, name: str, version: str = "", revision: str = "", dim: int = 0) -> str:
    """What tells vector spaces apart: the model's fields, each after its length in bytes."""
    return "modelref:v1:" + "".join(f"{len(f.encode())}:{f}" for f in (provider, name, version, revision, str(dim)))


def extension_allowed(path: Column | str, allow: Sequence[str] = (), deny: Sequence[str] = (), ignored: Sequence[str] = ()) -> Column:
    """Path filter: extensions (with or without a dot, any case) and names of directories to leave out."""
    norm = lambda xs: ["." + x.lower().lstrip(".") for x in xs]
    path = _col(path)
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    parts = F.split(path, "/")
    ok = ~F.arrays_overlap(parts, _words(list(ignored))) if ignored else F.lit(True)
    if deny:
        ok = ok & ~ext.isin(norm(deny))
    if allow:
        ok = ok & ext.isin(norm(allow))
    return ok


def parse_list(value: Column | str) -> Column:
    """Comma-separated values, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(_col(value), ","), lambda x: F.trim(x)), lambda x: x != "")


def is_prose(block: Column, word_count: Column) -> Column:
    """Code and tables aren't; headings need 3 words and others 5, where a count is known."""
    n = F.expr("null").cast("int") if word_count is None else word_count.try_cast("int")
    return F.when(block.isin("code", "table"), False).when(n.isNull(), True).otherwise(n >= F.when(block == "heading", 3).otherwise(5))


def is_analyzable(text: Column | str) -> Column:
    """Not a fenced block and not a pipe table."""
    lines = F.transform(F.split(_col(text), "\n"), lambda x: F.trim(x))
    first = F.element_at(lines, 1)
    rest = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    return ~(first.startswith("```") | (first.startswith("|") & F.exists(rest, lambda x: x.startswith("|") & x.contains("---"))))


def span_text(text: Column | str, start: Column, end: Column) -> Column:
    """The text of a half-open byte range, or null where it doesn't lie on character boundaries."""
    raw = F.encode(_col(text), "UTF-8")
    part = F.substring(raw, start + 1, end - start)
    return F.when((start >= 0) & (end >= start) & (end <= F.octet_length(_col(text))), F.when(F.is_valid_utf8(part.cast("string")), part.cast("string")))


def character_offset(text: Column | str, offset: Column) -> Column:
    """The number of characters before a byte offset, or null where it lies within a character or outside the text."""
    head = F.substring(F.encode(_col(text), "UTF-8"), F.lit(1), offset.cast("int")).cast("string")
    return F.when((offset >= 0) & (offset <= F.octet_length(_col(text))) & F.is_valid_utf8(head), F.char_length(head))


def byte_offset(text: Column | str, characters: Column) -> Column:
    return F.octet_length(F.left(_col(text), characters))


def recency(age: Column, half_life: Column | float) -> Column:
    """2 ** (-age / half_life); 1 where either isn't positive, 0 for NaN."""
    h = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    return F.when(F.isnan(age) | F.isnan(h), 0.0).when((age <= 0) | (h <= 0), 1.0).otherwise(F.pow(F.lit(2.0), -age / h))


def hash_embedding_token(token: bytes, dim: int) -> tuple[int, int]:
    """Dimension and sign of a token in the hashing embedder."""
    h = int(fnv1a([token])[0])
    return h % dim, -1 if h >> 63 else 1


def hashing_vectors(texts, dim: int = 256) -> list[np.ndarray]:
    """Hashing embedder: signed counts of the hashes of letter and digit runs, at unit length."""
    import regex

    dim = dim if dim > 0 else 256
    pattern = regex.compile(r"[\p{L}\p{Nd}]+")
    known: dict[str, int] = {}  # the words of this call in order, hashed together
    texts, out, places, signs = list(texts), [], np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(texts), 1000):
        found = [[known.setdefault(w, len(known)) for w in pattern.findall((t or "").lower())] for t in texts[at : at + 1000]]
        if len(known) > len(places):
            h = fnv1a([w.encode() for w in list(known)[len(places) :]])
            places = np.concatenate([places, (h % np.uint64(dim)).astype(np.int64)])
            signs = np.concatenate([signs, np.where(h >> np.uint64(63), -1.0, 1.0)])
        words = np.array([w for ws in found for w in ws], np.int64)
        row = np.repeat(np.arange(len(found)), [len(ws) for ws in found])
        v = np.bincount(row * dim + places[words], signs[words], len(found) * dim).reshape(-1, dim)  # whole numbers, so exact in any order
        norm = np.sqrt((v * v).sum(1))[:, None]
        out += list((v / np.where(norm > 0, norm, 1)).astype(np.float32))
    return out


def hashing_embedding(text: Column | str, dim: int = 256) -> Column:
    """The hashing embedder's vector of each text."""

    @pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(hashing_vectors(s, dim), index=s.index, dtype=object)

    return run(_col(text))
