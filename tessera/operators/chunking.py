"""Chunking: texts to chunks with byte spans, by named strategies.

A chunk is a piece of a text with its byte range (0, 0 where it can't be mapped back), counts, the headings above it and a
hash. Strategies are plain functions over one text; `chunk` applies one to a column of texts, Arrow batch by Arrow batch.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

DEFAULT_SIZE, DEFAULT_OVERLAP = 220, 0
SEPARATORS = {"default": ["\n\n", "\n", ". ", " ", ""], "cjk": ["\n\n", "\n", "。", "！", "？", "，", "、", "​", " ", ""]}
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st vs etc inc ltd co corp fig no vol al eg ie approx dept est gen gov hon rev sgt col capt".split())
LONG_SENTENCE = 1600
#: Documents whose chunks are held at once.
SLICE = 500


class Piece(NamedTuple):
    """A part of a text by character positions; start < 0 where it isn't a verbatim part."""

    text: str
    start: int = -1
    end: int = -1
    path: tuple[str, ...] = ()
    meta: tuple[tuple[str, str], ...] = ()


def _trimmed(text: str, start: int, end: int) -> Piece | None:
    part = text[start:end]
    inner = part.strip()
    if not inner:
        return None
    start += len(part) - len(part.lstrip())
    return Piece(inner, start, start + len(inner))


def paragraphs(text: str) -> list[Piece]:
    """Parts between blank lines."""
    out, at = [], 0
    for m in re.finditer(r"\n[ \t]*\n\s*", text):
        out.append(_trimmed(text, at, m.start()))
        at = m.end()
    out.append(_trimmed(text, at, len(text)))
    return [p for p in out if p]


def _lines(text: str) -> list[Piece]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append(_trimmed(text, at, at + len(line)))
        at += len(line) + 1
    return [p for p in out if p]


_FENCE = re.compile(r"^(```|~~~)[^\n]*\n.*?(?:^\1[ \t]*$|\Z)|(?:^(?: {4}|\t)[^\n]*(?:\n|\Z))+", re.M | re.S)
_STOP = re.compile(r"[.!?]+(?=\s|$)")
_SPACE, _LONG_SPACE = re.compile(r"\s+"), re.compile(r"\s{2,}")


def sentences(text: str) -> list[Piece]:
    """Parts that end in . ! or ? before white space, save after abbreviations; fenced and indented code stays whole.

    Where that finds one part that is very long, paragraphs or lines take its place, without spans.
    """
    out: list[Piece | None] = []

    def prose(lo: int, hi: int) -> None:
        at = lo
        for m in _STOP.finditer(text, lo, hi):
            word = re.search(r"([^\W\d_]+)$", text[max(lo, m.start() - 24) : m.start()])
            if m[0] == "." and word and word[1].lower() in ABBREVIATIONS:
                continue
            out.append(_trimmed(text, at, m.end()))
            at = m.end()
        out.append(_trimmed(text, at, hi))

    at = 0
    for m in _FENCE.finditer(text):
        prose(at, m.start())
        out.append(_trimmed(text, m.start(), m.end()))
        at = m.end()
    prose(at, len(text))
    found = [p for p in out if p]
    if not found or (len(found) == 1 and len(found[0].text) > LONG_SENTENCE):
        parts = paragraphs(text)
        return [Piece(p.text) for p in (parts if len(parts) > 1 else _lines(text))]
    return found


def words(text: str) -> list[str]:
    """Words and single white-space characters, in order."""
    return re.findall(r"\s|\S+", text)


@lru_cache(maxsize=2)
def _evened(text: str) -> tuple[str, list[int], list[int], list[int]]:
    """(the text with one space for each run of white space; where characters follow that went, here and in the text; how many went before)."""
    here, there, gone, total = [0], [0], [0], 0
    for m in _LONG_SPACE.finditer(text):
        here.append(m.start() + 1 - total)
        total += m.end() - m.start() - 1
        there.append(m.end())
        gone.append(total)
    return _SPACE.sub(" ", text), here, there, gone


def _spaced(text: str, words: str, at: int) -> tuple[int, int] | None:
    """The first place, from `at` on, of words joined by single spaces, with any white space for each of these."""
    even, here, there, gone = _evened(text)
    k = bisect_right(there, at) - 1
    start = at - gone[k]
    if k + 1 < len(here):  # within a run that was cut short, what follows is next
        start = min(start, here[k + 1])
    found = even.find(words, start)
    if found < 0:
        return None
    place = lambda i: i + gone[bisect_right(here, i) - 1]
    return place(found), place(found + len(words) - 1) + 1


def locate(text: str, fragment: str, cursor: int = 0, early: bool = False) -> tuple[int, int] | None:
    """Where a fragment lies in a text: verbatim from the cursor on, verbatim anywhere, or with any white space for its white space.

    The last from the cursor on, then anywhere; with `early`, from the cursor on before verbatim anywhere. None if it isn't there.
    """
    if not fragment:
        return None
    cursor = cursor if 0 <= cursor <= len(text) else 0
    verbatim = lambda at: (i, i + len(fragment)) if (i := text.find(fragment, at)) >= 0 else None
    loose = " ".join(fragment.split())
    spaced = lambda at: _spaced(text, loose, at) if loose else None
    ways = [(verbatim, cursor), (spaced, cursor), (verbatim, 0), (spaced, 0)] if early else [(verbatim, cursor), (verbatim, 0), (spaced, cursor), (spaced, 0)]
    return next((found for way, at in ways if (found := way(at))), None)


def _joined(parts: list[Piece], text: str, by: str) -> Piece:
    whole = by.join(p.text for p in parts)
    if all(p.start >= 0 for p in parts) and parts:
        lo, hi = parts[0].start, parts[-1].end
        return Piece(whole, lo, hi, parts[0].path)
    return Piece(whole, path=parts[0].path if parts else ())


def hard_limit(pieces: list[Piece], size: int, text: str) -> list[Piece]:
    """No piece over size: paragraphs, then sentences, words and characters are cut apart; blank pieces go."""
    out = []
    for p in pieces:
        if not p.text.strip():
            continue
        if size <= 0 or len(p.text) <= size:
            out.append(p)
            continue
        at = 0
        for sub in _cascade(p.text, size):
            sub = sub.strip()
            if not sub:
                continue
            found = text.find(sub, p.start + at, p.end) if p.start >= 0 else -1
            if found >= 0:
                at = found + len(sub) - p.start
                out.append(Piece(sub, found, found + len(sub), p.path, p.meta))
            else:
                out.append(Piece(sub, path=p.path, meta=p.meta))
    return out


_LEVELS = ((lambda t: [p.text for p in paragraphs(t)], "\n\n"), (lambda t: [s.text for s in sentences(t)], " "), (str.split, " "))


def _cascade(text: str, size: int, level: int = 0) -> list[str]:
    for k in range(level, len(_LEVELS)):
        cut, by = _LEVELS[k]
        parts = cut(text)
        if len(parts) < 2:
            continue
        out, now = [], ""
        for part in parts:
            longer = now + by + part if now else part
            if len(longer) <= size:
                now = longer
                continue
            if len(now) > size // 2 or len(part) <= size:
                if now:
                    out.append(now)
                now = ""
                longer = part
            if len(longer) <= size:
                now = longer
            else:
                out += _cascade(longer, size, k + 1)
                now = ""
        return out + [now] if now else out
    return [text[i : i + size] for i in range(0, len(text), size)]


def hard_cut(text: str, size: int, overlap: int) -> list[Piece]:
    cuts = [(max(0, i - overlap) if i and overlap > 0 else i, min(len(text), i + size)) for i in range(0, len(text), size)]
    return hard_limit([Piece(text[a:b], a, b) for a, b in cuts], size, text)


def _pack_sentences(text: str, size: int, overlap: int, spaced: bool) -> list[Piece]:
    parts, out, i, tail = sentences(text), [], 0, []
    while i < len(parts):
        lead = ""
        if out and overlap > 0 and tail:
            joined = " ".join(t.text for t in tail)
            lead = joined + " " if len(joined.encode()) <= overlap else ""
        used, taken = len(lead), []
        while i < len(parts) and used + len(parts[i].text) + (1 if spaced and taken else 0) <= size:
            used += len(parts[i].text) + (1 if taken else 0)
            taken.append(parts[i])
            i += 1
        if not taken:
            taken = [parts[i]]
            i += 1
        p = _joined(taken, text, " ")
        out.append(Piece(lead + p.text, -1 if lead else p.start, -1 if lead else p.end))
        tail, size_left = [], overlap
        for t in reversed(taken):
            if len(t.text.encode()) > size_left:
                break
            tail.insert(0, t)
            size_left -= len(t.text.encode())
    return hard_limit(out, size, text)


def smart_boundary(text: str, size: int, overlap: int) -> list[Piece]:
    """Whole sentences while they fit; overlap only if the last ones fit into it."""
    return _pack_sentences(text, size, overlap, False)


def sentence_boundary(text: str, size: int, overlap: int) -> list[Piece]:
    """As smart_boundary, with the joining spaces counted."""
    return _pack_sentences(text, size, overlap, True)


def word_boundary(text: str, size: int, overlap: int) -> list[Piece]:
    """Words and the white space between them while they fit; the last words within the overlap are repeated."""
    out, at, i, tokens, lead = [], 0, 0, words(text), ""
    while i < len(tokens):
        used, start, taken = len(lead), at, []
        while i < len(tokens) and (used + len(tokens[i]) <= size or not taken):
            taken.append(tokens[i])
            used += len(tokens[i])
            at += len(tokens[i])
            i += 1
        p = _trimmed(text, start, at)
        if p:
            out.append(Piece(lead + p.text) if lead else p)
        lead, left, kept = "", overlap, []
        for w in reversed([t for t in taken if t.strip()]):
            if len(w) + 1 > left:
                break
            kept.insert(0, w)
            left -= len(w) + 1
        lead = " ".join(kept) + " " if kept and overlap > 0 and i < len(tokens) else ""
    return hard_limit(out, size, text)


def _shift(pieces: list[Piece], by: int) -> list[Piece]:
    return [p._replace(start=p.start + by, end=p.end + by) if p.start >= 0 and by >= 0 else p._replace(start=-1, end=-1) for p in pieces]


def paragraph_aware(text: str, size: int, overlap: int) -> list[Piece]:
    """Paragraphs while they fit with a blank line between; one that is too long goes by words."""
    parts, out, i = paragraphs(text), [], 0
    while i < len(parts):
        used, taken = 0, []
        while i < len(parts) and used + len(parts[i].text) + 2 <= size:
            used += len(parts[i].text) + (2 if taken else 0)
            taken.append(parts[i])
            i += 1
        if taken:
            out.append(_joined(taken, text, "\n\n"))
        else:
            out += _shift(word_boundary(parts[i].text, size, overlap), parts[i].start)
            i += 1
    return hard_limit(out, size, text)


class Block(NamedTuple):
    kind: str
    piece: Piece
    level: int = 0


def blocks(text: str) -> list[Block]:
    """Markdown blocks: headings, paragraphs, fenced code, lists, tables and quotes."""
    out, lines, at = [], text.split("\n"), 0
    starts = []
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    kind_of = lambda s: "list" if re.match(r"\s{0,3}(?:[-*+]|\d+[.)])\s", s) else "quote" if s.lstrip().startswith(">") else "table" if s.lstrip().startswith("|") else "paragraph"
    i = 0
    while i < len(lines):
        s = lines[i]
        if not s.strip():
            i += 1
            continue
        j, kind, level = i + 1, "", 0
        if m := re.match(r"(#{1,6})(?:\s|$)", s):
            kind, level = "heading", len(m[1])
        elif m := re.match(r"\s{0,3}(```+|~~~+)", s):
            kind = "code"
            while j < len(lines) and not lines[j].strip().startswith(m[1]):
                j += 1
            j = min(len(lines), j + 1)
        else:
            kind = kind_of(s)
            while j < len(lines) and lines[j].strip() and not re.match(r"#{1,6}(?:\s|$)|\s{0,3}(?:```|~~~)", lines[j]) and (kind_of(lines[j]) == kind or (kind in ("list", "quote") and kind_of(lines[j]) == "paragraph")):
                j += 1
        end = starts[j - 1] + len(lines[j - 1])
        p = _trimmed(text, starts[i], end)
        if p:
            meta = [("type", kind), ("word_count", str(len(p.text.split()))), ("line_count", str(p.text.count("\n") + 1))]
            if level:
                meta.append(("heading_level", str(level)))
            if kind == "code" and (lang := s.strip().strip("`~").strip()):
                meta.append(("language", lang))
            out.append(Block(kind, p._replace(meta=tuple(meta)), level))
        i = j
    return out


def markdown_aware(text: str, size: int, overlap: int) -> list[Piece]:
    """Blocks while they fit; a table that is too long is cut into tables that repeat its head; other long blocks go by words."""
    out: list[Piece] = []
    taken: list[Piece] = []
    used = 0

    def flush():
        nonlocal taken, used
        if taken:
            out.append(taken[0] if len(taken) == 1 else _joined(taken, text, "\n\n"))
        taken, used = [], 0

    for b in blocks(text):
        p = b.piece
        if used + len(p.text) + (2 if taken else 0) <= size:
            used += len(p.text) + (2 if taken else 0)
            taken.append(p)
            continue
        flush()
        if len(p.text) <= size:
            taken, used = [p], len(p.text)
        elif b.kind == "table":
            rows = p.text.split("\n")
            n = 2 if len(rows) > 1 and "---" in rows[1] else 1
            head, now = "\n".join(rows[:n]), ""
            for r in rows[n:]:
                if now and len(head) + len(now) + len(r) + 2 > size:
                    out.append(Piece(head + "\n" + now, meta=p.meta))
                    now = ""
                now = now + "\n" + r if now else r
            out.append(Piece(head + "\n" + now, meta=p.meta))
        else:
            out += [q._replace(meta=p.meta) for q in _shift(word_boundary(p.text, size, overlap), p.start)]
    flush()
    return hard_limit(out, size, text)


def heading_aware(text: str, size: int, overlap: int) -> list[Piece]:
    """Sections by headings, each with the headings above it as its path; one that is too long is split at the next level, then by sentences."""
    heads = [b for b in blocks(text) if b.kind == "heading"]

    def section(lo: int, hi: int, path: tuple[str, ...], level: int) -> list[Piece]:
        p = _trimmed(text, lo, hi)
        if not p:
            return []
        if len(p.text) <= size:
            return [p._replace(path=path)]
        for depth in range(level, 7):
            inner = [h for h in heads if lo <= h.piece.start < hi and h.level == depth]
            if inner:
                edges = [h.piece.start for h in inner]
                out = section(lo, edges[0], path, depth + 1) if edges[0] > lo else []
                for h, nxt in zip(inner, edges[1:] + [hi]):
                    out += section(h.piece.start, nxt, (*path, h.piece.text.lstrip("#").strip()), depth + 1)
                return out
        return [q._replace(path=path) for q in _shift(smart_boundary(p.text, size, overlap), p.start)]

    return hard_limit(section(0, len(text), (), 1), size, text)


def optimal(text: str, size: int, overlap: int = 0) -> list[Piece]:
    """One piece up to size; else each window is cut at its last blank line, or at its last '. ' if it has none, past the middle only."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            cut = text.rfind("\n\n", at, end)
            step = 2
            if cut < 0:
                cut, step = text.rfind(". ", at, end), 1
            if cut - at > size // 2:
                end = cut + step
        p = _trimmed(text, at, end)
        if p:
            out.append(p)
        at = end
    return out


def token_pieces(text: str, size: int, overlap: int, tokenizer=None) -> list[Piece]:
    """Windows of tokens with a step of size - overlap; without a tokenizer (encode, decode), words at four characters a token."""
    if tokenizer is None:
        return word_boundary(text, size * 4, overlap * 4)
    overlap = min(max(overlap, 0), size - 1)
    ids, out, at = tokenizer.encode(text), [], 0
    for i in range(0, len(ids), size - overlap):
        last = i + size >= len(ids)
        part = tokenizer.decode(ids[i : i + size])
        if not last:
            part = _whole_end(part)
        if i:
            part = _whole_start(part)
        if part:
            found = text.find(part, at)
            out.append(Piece(part, found, found + len(part)) if found >= 0 else Piece(part))
            if found >= 0:
                at = found + 1 if overlap else found + len(part)
        if last:
            break
    return hard_limit(out, size * 6, text)


def _whole_start(part: str) -> str:
    """Without what is likely the rest of a word: up to nine bytes before white space."""
    m = re.search(r"[ \n\t]", part)
    return part[m.start() + 1 :] if m and 0 < len(part[: m.start()].encode()) < 10 else part


def _whole_end(part: str) -> str:
    """Up to a sentence's end in the last 20 bytes, else up to white space in the last 10, else as it is."""
    for ends, reach, keep in ((".!?", 20, 1), (" \n\t", 10, 0)):
        at = max(part.rfind(c) for c in ends)
        if at > 0 and len(part[at:].encode()) < reach:
            return part[: at + keep]
    return part


def within_tokens(text: str, limit: int, count: Callable[[str], int]) -> list[str]:
    """Parts of at most `limit` tokens: sentences, then words, then characters; an error where not even one character fits."""
    if count(text) <= limit:
        return [text]
    for parts, by in (([s.text for s in sentences(text)], " "), (text.split(), " "), (list(text), "")):
        if len(parts) < 2:
            continue
        out, now = [], ""
        for p in parts:
            longer = now + by + p if now else p
            if count(longer) <= limit:
                now = longer
                continue
            if now:
                out.append(now)
            now = p
            if count(p) > limit:
                out += within_tokens(p, limit, count)
                now = ""
        return out + [now] if now else out
    raise ValueError("not even one character fits the token limit")


def units(text: str) -> list[Piece]:
    """Semantic units: conversation turns, else sections, else parts between rules, else paragraphs, whichever first gives two; else sentences."""
    for pattern in (r"^(?:#+\s*)?(?:\*\*)?(?:user|assistant|system|human)\b[^\n]*$", r"^#{2,3}\s", r"^(?:-{3,}|\*{3,}|_{3,})\s*$"):
        edges = [m.start() for m in re.finditer(pattern, text, re.M | re.I)]
        if edges:
            parts = [p for a, b in zip([0, *edges], [*edges, len(text)]) if (p := _trimmed(text, a, b))]
            if len(parts) >= 2:
                return parts
    parts = paragraphs(text)
    return parts if len(parts) >= 2 else sentences(text)


def semantic(text: str, size: int, overlap: int, embed: Callable[[list[str]], list] | None = None, sensitivity: float = 1.0) -> list[Piece]:
    """Units grouped where neighbouring embeddings are alike. Fewer than three units, or no usable embeddings, fall back to sentences."""
    import numpy as np

    parts = units(text)
    if embed is None or len(parts) < 3:
        return smart_boundary(text, size, overlap)
    try:
        v = np.array(embed([p.text for p in parts]), float)
    except ValueError:
        return smart_boundary(text, size, overlap)
    if v.ndim != 2 or len(v) != len(parts) or not np.isfinite(v).all():
        return smart_boundary(text, size, overlap)
    n = np.sqrt((v * v).sum(1))
    u = v / np.where(n > 0, n, 1)[:, None]
    sim = (u[:-1] * u[1:]).sum(1)
    if len(sim) > 1:
        sim = np.concatenate([[(sim[0] + sim[1]) / 2], (sim[:-2] + sim[1:-1] + sim[2:]) / 3, [(sim[-2] + sim[-1]) / 2]])
    t = min(0.95, max(0.1, sim.mean() - sensitivity * sim.std()))
    groups: list[list[int]] = [[0]]
    for i, s in enumerate(sim):
        if s < t:
            groups.append([])
        groups[-1].append(i + 1)
    merged: list[list[int]] = []
    size_of: list[int] = []
    for g in groups:
        n = sum(len(parts[i].text) + 2 for i in g)
        if merged and size_of[-1] + n <= LONG_SENTENCE and (size_of[-1] < 200 or n < 200 or float(np.dot(u[merged[-1]].mean(0), u[g].mean(0))) >= 0.92):
            merged[-1] += g
            size_of[-1] += n
        else:
            merged.append(list(g))
            size_of.append(n)
    return hard_limit([_joined([parts[i] for i in g], text, "\n\n") for g in merged], max(size, 1), text)


STRATEGIES: dict[str, Callable[[str, int, int], list[Piece]]] = {
    "hard_cut": hard_cut, "smart": smart_boundary, "sentence": sentence_boundary, "word": word_boundary, "paragraph": paragraph_aware,
    "markdown": markdown_aware, "heading": heading_aware, "optimal": optimal, "token": token_pieces, "semantic": semantic,
}

CHUNK = "id int, text string, char_count int, word_count int, token_count int, start int, end int, path array<string>, metadata map<string,string>, content_hash string"


def pieces(text: str | None, strategy: str = "smart", size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP, count: Callable[[str], int] | None = None, **options) -> list[dict]:
    """Chunk rows of one text; none for an empty text or a size of 0 or less."""
    if not text or size <= 0:
        return []
    if count is None and options.get("tokenizer") is not None:
        count = options["tokenizer"].count
    out, at, byte, cursor = [], 0, 0, 0
    for i, p in enumerate(STRATEGIES[strategy](text, size, max(0, overlap), **options)):
        start = end = 0
        if p.start < 0 and (found := locate(text, p.text, cursor)):
            p = p._replace(start=found[0], end=found[1])
        cursor = p.start if p.start >= 0 else cursor
        if p.start >= 0 and text[p.start : p.end].strip() and p.end > p.start:
            byte = byte + len(text[at : p.start].encode()) if p.start >= at else len(text[: p.start].encode())
            at = p.start
            start, end = byte, byte + len(text[p.start : p.end].encode())
        h = hashlib.sha256(p.text.encode()).hexdigest()[:16]
        out.append({"id": i, "text": p.text, "char_count": len(p.text), "word_count": len(p.text.split()), "token_count": count(p.text) if count else 0, "start": start, "end": end, "path": list(p.path), "metadata": dict(p.meta), "content_hash": h})
    return out


def chunks_of(text: Column | str, strategy: str = "smart", size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP, **options) -> Column:
    """An array of chunks for each text."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")

    @pandas_udf(f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in CHUNK.split(', '))}>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: pieces(t, strategy, size, overlap, **options))

    return run(F.col(text) if isinstance(text, str) else text)


def chunk(docs: DataFrame, strategy: str = "smart", size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id_column, chunk columns): a row for each chunk of each document; a map without a shuffle. Rows are built column by column, a slice of documents at a time."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    schema = f"`{id_column}` {dict(docs.dtypes)[id_column]}, {CHUNK}"

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
        fields = [(c.split(" ", 1)[0], kinds[c.split(" ", 1)[1]]) for c in CHUNK.split(", ")]
        for b in batches:
            for at in range(0, len(b), SLICE):
                found = [pieces(t, strategy, size, overlap, **options) for t in b.column(1).slice(at, SLICE).to_pylist()]
                owner = pa.array([k for k, f in enumerate(found) for _ in f], pa.int64())
                rows = [r for f in found for r in f]
                columns = [pa.array([list(r[c].items()) if c == "metadata" else r[c] for r in rows], kind) for c, kind in fields]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, SLICE).take(owner), *columns], names=[id_column, *(c for c, _ in fields)])

    return docs.select(id_column, text).mapInArrow(run, schema)


def strategic_sample(text: Column | str, most: int = 15_000) -> Column:
    """The text, or, if it is longer than `most`, its first two thirds of that, a part of the middle and of the end, with marks between."""
    t = F.col(text) if isinstance(text, str) else text
    n = F.char_length(t)
    head, part = most * 2 // 3, most // 6
    middle = F.substring(t, F.floor(n / 2 - part / 2).cast("int") + 1, F.lit(part))
    return F.when(n <= most, t).otherwise(F.concat(F.substring(t, F.lit(1), F.lit(head)), F.lit("\n\n[… middle …]\n"), middle, F.lit("\n\n[… end …]\n"), F.substring(t, n - part + 1, F.lit(part))))


def result_rows(docs: DataFrame, strategy: str = "smart", size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> DataFrame:
    """Chunks as rows of a store: id = document#chunk, with the lines of each in the metadata."""
    from ..functions.text import line_number, normalize_text

    clean = docs.withColumn("text", normalize_text("text"))
    rows = clean.select(F.col("id").alias("document_id"), F.coalesce("title", F.lit("")).alias("filename"), F.col("text").alias("__doc"), F.inline(chunks_of("text", strategy, size, overlap)))
    spanned = (F.col("start") != 0) | (F.col("end") != 0)
    lines = F.when(spanned, F.map_from_arrays(F.array(F.lit("line_start"), F.lit("line_end")), F.array(line_number("__doc", F.col("start")).cast("string"), line_number("__doc", F.col("end")).cast("string"))))
    return rows.select(F.concat("document_id", F.lit("#"), F.col("id").cast("string")).alias("id"), "document_id", "filename", F.col("text").alias("content"), F.map_concat(F.map_filter("metadata", lambda k, v: ~k.isin("line_start", "line_end")), F.coalesce(lines, F.create_map().cast("map<string,string>"))).alias("metadata"), "start", "end", "content_hash")
