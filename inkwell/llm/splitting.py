"""Splitting oversized items at natural boundaries (problem 10).

Every place between two tokens of a text has a strength: a new mail part or message, a blank line, a change of the quotation
depth, a line, a sentence, a blank, a word, anything else between characters. A sparse table of range maxima over the
strengths gives the strongest cut in the window of permissible piece lengths; of equal ones the rightmost. The next piece
begins the overlap before the cut. All texts of a slice advance together. Texts are processed whole; what travels with their
words (see ``bpe``) is the strength of the cut before each word, since a cut within a word follows from its tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import bpe

#: Strengths of a cut, from within a character (never) to a new part.
WITHIN, CHARACTER, WORD, BLANK, SENTENCE, LINE, QUOTE, PARAGRAPH, PART = -1, 0, 1, 2, 3, 4, 5, 6, 7


def boundary_strengths(raw: bytes, text_starts: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """int8 per byte: how strong a cut before it is."""
    n = len(raw)
    u = np.frombuffer(raw, np.uint8)
    s = np.where((u & 0xC0) == 0x80, WITHIN, CHARACTER).astype(np.int8)
    s[word_starts] = WORD
    back = lambda at, k: np.where(at >= k, u[np.maximum(at - k, 0)], 0)
    w = word_starts
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    b1, b2, b3 = back(w, 1), back(w, 2), back(w, 3)
    s[w[white[u[w]] | white[b1]]] = BLANK
    stops = np.isin(b1, np.frombuffer(b".!?", np.uint8)) & white[u[w]]
    wide = (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x82) | (b3 == 0xEF) & (b2 == 0xBC) & np.isin(b1, np.array([0x81, 0x9F], np.uint8))  # ideographic stops
    s[w[stops | wide]] = SENTENCE
    lines = np.flatnonzero(u[:-1] == 10) + 1 if n > 1 else np.zeros(0, np.int64)
    lines = lines[s[lines] >= WORD]
    s[lines] = LINE
    # depth of quotation of every line: its marks, each with at most one blank before it, up to the first other character
    pad = np.concatenate([u, np.zeros(2, np.uint8)])
    mark = pad[:-1] == 62
    other = np.flatnonzero(~(mark | (pad[:-1] == 32) & (pad[1:] == 62)))
    marks = np.concatenate([[0], np.cumsum(mark)])
    depth = marks[other[np.searchsorted(other, lines)]] - marks[lines]
    if len(lines) > 1:
        s[lines[1:][depth[1:] != depth[:-1]]] = QUOTE
    p2, p3 = back(lines, 2), back(lines, 3)
    s[lines[(p2 == 10) | (p2 == 13) & (p3 == 10)]] = PARAGRAPH
    dashes = (pad[lines] == 45) & (pad[np.minimum(lines + 1, n)] == 45) & ~white[pad[np.minimum(lines + 2, n + 1)]]
    mbox = (pad[lines] == 70) & (s[lines] == PARAGRAPH)  # "From " behind a blank line
    if len(lines):
        for k, ch in enumerate(b"From "):
            mbox &= np.concatenate([pad, np.zeros(8, np.uint8)])[lines + k] == ch
    s[lines[dashes | mbox]] = PART
    s[text_starts] = PART
    return s


def cuts(strength: np.ndarray, begin: np.ndarray, end: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, from, to) of the pieces of texts that lie at tokens ``begin``..``end``; ``strength`` is that of the cut before each
    token. A cut lies at least half the limit, and more than the overlap, behind the start of its piece."""
    least = max(limit // 2, overlap + 1)
    span = limit - least + 1
    key = (strength.astype(np.int64) << 40) + np.arange(len(strength))
    level = max(0, span.bit_length() - 1)
    table = key
    for j in range(level):
        table = np.maximum(table[: len(table) - (1 << j)], table[1 << j :]) if len(table) > 1 << j else table
    text = np.arange(len(begin))
    at = begin.copy()
    who, lo, hi = [], [], []
    while len(text):
        done = end[text] - at <= limit
        who.append(text[done])
        lo.append(at[done])
        hi.append(end[text[done]])
        text, at = text[~done], at[~done]
        if not len(text):
            break
        first, last = at + least, at + limit
        best = np.maximum(table[first], table[last - (1 << level) + 1])
        cut = best & ((1 << 40) - 1)
        who.append(text)
        lo.append(at)
        hi.append(cut)
        at = cut - overlap
        for _ in range(3):  # not within a character
            at = at - (strength[at] == WITHIN)
    who, lo, hi = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, lo, hi))
    order = np.lexsort((lo, who))
    return who[order], lo[order], hi[order]


def _pieces(vocab: bpe.Vocabulary, limit: int, overlap: int) -> bpe.Finish:
    def finish(ids: pa.Array, nulls: np.ndarray, code: np.ndarray, rows: np.ndarray, mark: np.ndarray, tokens: np.ndarray, per_word: np.ndarray) -> pa.RecordBatch:
        flat = bpe.gather(tokens, per_word, code)
        first = np.concatenate([[0], np.cumsum(per_word[code])])  # token at which each word begins
        strength = np.where(vocab.within[flat], WITHIN, CHARACTER).astype(np.int8)
        strength[first[:-1]] = mark
        filled = np.flatnonzero(rows[1:] > rows[:-1])
        begin, end = first[rows[filled]], first[rows[filled + 1]]
        who, lo, hi = cuts(strength, begin, end, limit, overlap) if len(flat) else (np.zeros(0, np.int64),) * 3
        chars, at = (np.concatenate([[0], np.cumsum(v[flat])]) for v in (vocab.characters, vocab.byte_length))
        text = bpe.gather(vocab.token_bytes, vocab.byte_length, flat).tobytes()
        new = np.append(True, who[1:] != who[:-1])[: len(who)]
        start = np.maximum.accumulate(np.where(new, np.arange(len(who)), 0)) if len(who) else who
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(filled[who])),
                pa.array((np.arange(len(who)) - start + 1).astype(np.int32)),
                pa.array(lo - begin[who], pa.int64()),
                pa.array(hi - lo, pa.int64()),
                pa.array(chars[lo] - chars[begin[who]], pa.int64()),
                pa.array(chars[hi] - chars[lo], pa.int64()),
                pa.array([text[i:j] for i, j in zip(at[lo].tolist(), at[hi].tolist(), strict=True)], pa.binary()).cast(pa.string()),
            ],
            names=["id", "piece", "token_from", "n_tokens", "char_from", "n_chars", "text"],
        )

    return finish


def _finish_with(path: str, limit: int, overlap: int) -> bpe.Finish:
    def finish(*slice_: object) -> pa.RecordBatch:
        return _pieces(bpe.vocabulary(path), limit, overlap)(*slice_)

    return finish


def split_texts(df: DataFrame, limit: int, overlap: int, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, piece, token_from, n_tokens, char_from, n_chars, text): the pieces of every text, in tokens of the text's own
    encoding. Texts within ``limit`` tokens are one piece; no piece is longer. Consecutive pieces share ``overlap`` tokens (up to
    three more where that would fall within a character). Null and empty texts have no piece; repeated ids give repeated
    pieces; other columns are ignored; an empty table gives no row. Bytes that are no UTF-8 come out as U+FFFD. ``limit`` has to be
    at least twice ``overlap`` plus 16, so that every window holds the end of a character."""
    if overlap < 0 or limit < 2 * overlap + 16:
        raise ValueError("the limit has to be at least twice the overlap plus 16")
    path = path or bpe.default_path()
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, token_from bigint, n_tokens bigint, char_from bigint, n_chars bigint, text string"
    return bpe.encoded(df, id_col, text, path, _finish_with(path, limit, overlap), schema, boundary_strengths).withColumnRenamed("id", id_col)


def rejoined(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text): each text put together again from its pieces, without the overlaps. Ids have to be unique."""
    behind = F.lead("char_from").over(Window.partitionBy(id_col).orderBy("piece"))
    own = pieces.select(id_col, "piece", F.when(behind.isNull(), F.col("text")).otherwise(F.substring("text", F.lit(1), (behind - F.col("char_from")).cast("int"))).alias("t"))
    return own.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("piece", "t"))).alias("p")).select(id_col, F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))
