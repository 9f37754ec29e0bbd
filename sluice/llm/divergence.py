"""How the words of a language's sources differ from each other, in exact whole numbers.

Each language keeps the terms of at least ``IN_DOCUMENTS`` of its documents.
A group (a source of a language, or the whole language) gives a kept term
p = 1 + floor(10^9 (count + 1) / (N + V)), N being the group's kept tokens
and V the language's kept terms.  Against another group's q a term weighs
floor((p - q)^2 / q); the sum over all terms is the divergence of the two.

A byte-level tokenizer counts: a lookup table over the UTF-8 buffer of a
whole Arrow batch finds the terms' boundaries, xxhash groups the slices and
the bytes of every slice are compared with those of its group.  Counts per
(language, source, term) then meet by term, in stretches of terms, each a
sparse matrix of terms by sources; the divergences of a stretch are sums
over its rows, and the stretches' sums are added up in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

IN_DOCUMENTS = 3
SCALE = 1_000_000_000
#: Ranks of terms that a report holds for each source.
TOP = 200
#: Values that are worked on at once, cells of a language's matrix in a task, bytes of text that are cut at once.
BLOCK, CELLS, PIECE = 1 << 20, 1 << 16, 1 << 23

#: What a byte of a term becomes; zero ends a term.  Letters of ASCII and all bytes of other characters make terms.
_TERM = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def term_slices(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, first and last byte of each term, and its row, of texts whose bytes lie end to end in ``raw``."""
    folded = _TERM[raw]
    inside = folded > 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]  # no term goes on into the next row
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return folded, first, last, np.searchsorted(offsets, first, "right") - 1


def _gathered(folded: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of many slices, end to end."""
    at = np.repeat(first - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    return folded[at + np.arange(len(at))]


def group_slices(folded: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A number per slice, equal for equal bytes, and each number's bytes.

    Slices group by their xxhash; then all bytes are compared with those of
    the group's first slice, and a group that holds others is split.
    """
    whole = folded.tobytes()
    digest = np.fromiter([xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64, len(first))
    _, head, number = np.unique(digest, return_index=True, return_inverse=True)
    number = number.astype(np.int64)
    length = last - first
    as_head = length == length[head][number]
    for at in range(0, len(first), 1 << 18):
        part = slice(at, at + (1 << 18))
        like = np.flatnonzero(as_head[part]) + at
        if len(like):
            same = _gathered(folded, first[like], length[like]) == _gathered(folded, first[head[number[like]]], length[like])
            as_head[like] = np.logical_and.reduceat(same, np.concatenate(([0], np.cumsum(length[like])[:-1])))
    terms = [whole[a:b] for a, b in zip(first[head].tolist(), last[head].tolist(), strict=True)]
    others: dict[bytes, int] = {}
    for k in np.flatnonzero(~as_head).tolist():  # two texts with one hash
        term = whole[first[k] : last[k]]
        if term not in others:
            others[term] = len(terms)
            terms.append(term)
        number[k] = others[term]
    return number, terms


def _text(c: pa.Array) -> pa.Array:
    return c.cast(pa.large_string()).fill_null("")


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in rows of about ``PIECE`` bytes of text, a longer text alone."""
    ends = np.cumsum(np.diff(np.frombuffer(_text(batch.column(0)).buffers()[1], np.int64, batch.num_rows + 1)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, PIECE + (ends[at - 1] if at else 0), "right")))
        yield batch.slice(at, to - at)
        at = to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang, source) to (lang, source, term, n, n_docs) of a piece; a group's null term tells that it occurs."""
    for batch in (piece for b in batches for piece in _pieces(b)):
        text, lang, source = (_text(c) for c in batch.columns)
        label: dict[tuple[str, str], int] = {}
        group = np.array([label.setdefault(g, len(label)) for g in zip(lang.to_pylist(), source.to_pylist(), strict=True)], np.int64)
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        folded, first, last, row = term_slices(offsets - offsets[0], raw)
        number, terms = group_slices(folded, first, last)
        wide = max(len(terms), 1)
        in_doc, n = np.unique(row * wide + number, return_counts=True)  # documents by terms
        cell, at = np.unique(group[in_doc // wide] * wide + in_doc % wide, return_inverse=True)  # groups by terms
        order, starts = np.argsort(at, kind="stable"), np.searchsorted(np.sort(at), np.arange(len(cell)))
        counts = np.add.reduceat(n[order], starts) if len(cell) else n
        documents = np.bincount(at, minlength=len(cell))
        langs, sources = (pa.array([g[k] for g in label], pa.string()) for k in (0, 1))
        names = pa.array([t.decode("utf-8", "replace") for t in terms], pa.string())
        of, none = pa.array(np.concatenate((cell // wide, np.arange(len(label))))), np.zeros(len(label), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                langs.take(of),
                sources.take(of),
                pa.concat_arrays([names.take(pa.array(cell % wide)), pa.nulls(len(label), pa.string())]),
                *(pa.array(np.concatenate((v, none)), pa.int64()) for v in (counts, documents)),
            ],
            names=["lang", "source", "term", "n", "n_docs"],
        )


def count_terms(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, n_docs)``, and one row of null term for each (lang, source) that occurs."""
    found = docs.select("text", "lang", "source").mapInArrow(_count, "lang string, source string, term string, n long, n_docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), exact for totals up to 2.8 * 10^14: 10^9 is taken as 31,250 times 32,000."""
    whole, rest = np.divmod((count + 1) * 31_250, total)
    return 1 + whole * 32_000 + rest * 32_000 // total


def weight(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _best(source: np.ndarray, value: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` largest values of each source and of all that equal the last of them."""
    by = np.lexsort((-value, source))
    nth = np.arange(len(by)) - np.searchsorted(source[by], source[by])
    least = np.full(source.max(initial=-1) + 1, -1, np.int64)
    least[source[by][nth == top - 1]] = value[by][nth == top - 1]
    return by[value[by] >= least[source[by]]]


def _pairs(source: np.ndarray, p: np.ndarray, indptr: np.ndarray, none: np.ndarray, low: int, high: int) -> np.ndarray:
    """Summed weights of the sources ``low`` to ``high`` against all, over the terms of one stretch.

    The matrix is sparse: cell k is (term, source[k]) with share p[k], terms
    lie at ``indptr``, and a source has share none[source] in all other
    terms.  What a pair would have if no cell were set is corrected by the
    cells of the one, of the other, and of both.
    """
    s, terms = len(none), len(indptr) - 1
    own = none[low:high, None]
    empty = weight(own, none[None])
    sums = terms * empty
    by_source = np.argsort(source, kind="stable")
    edges = np.searchsorted(source[by_source], np.arange(s + 1))

    def cells(first: int, last: int, to: np.ndarray, against) -> None:
        """Add to row ``r`` of ``to`` the sum of ``against(p, r)`` over the cells of source ``first + r``."""
        step = max(1, BLOCK // to.shape[1])
        for at in range(edges[first], edges[last], step):
            part = by_source[at : min(at + step, edges[last])]
            rows, heads = np.unique(source[part], return_index=True)
            to[rows - first] += np.add.reduceat(against(p[part, None], source[part]), heads, axis=0)

    cells(low, high, sums, lambda x, r: weight(x, none[None]) - empty[r - low])
    turned = np.zeros((s, high - low), np.int64)
    cells(0, s, turned, lambda x, r: weight(own.T, x) - empty.T[r])
    sums += turned.T
    width = np.diff(indptr)
    term = np.repeat(np.arange(terms), width)
    mine = np.flatnonzero((source >= low) & (source < high))
    meets = np.cumsum(width[term[mine]])
    at = 0
    while at < len(mine):
        to = max(at + 1, int(np.searchsorted(meets, BLOCK + (meets[at - 1] if at else 0), "right")))
        a = mine[at:to]
        n = width[term[a]]
        b = np.repeat(indptr[term[a]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        a = np.repeat(a, n)
        row, column = source[a] - low, source[b]
        both = weight(p[a], p[b]) - weight(p[a], none[column]) - weight(own[row, 0], p[b]) + empty[row, column]
        np.add.at(sums.reshape(-1), row * s + column, both)
        at = to
    return sums


def _stretch(table: pa.Table, top: int) -> Iterator[tuple[str, str, list, np.ndarray]]:
    """(source, part, items, values) of one stretch of a language's terms.

    Rows with a null term hold a source's name and its N + V; the row whose
    source is null too holds those of the language.
    """
    rows = table.to_pandas(types_mapper={pa.int64(): None}.get)
    head = rows[rows["term"].isna()]
    language = int(head.loc[head["source"].isna(), "n"].iloc[0])
    head = head[head["source"].notna()].sort_values("source")
    names, total = head["source"].to_numpy(), head["n"].to_numpy(np.int64)
    cell = rows[rows["term"].notna()].sort_values(["term", "source"])
    source = np.searchsorted(names, cell["source"].to_numpy()) if len(cell) else np.zeros(0, np.int64)
    n, term = cell["n"].to_numpy(np.int64), cell["term"].to_numpy()
    indptr = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term)) if len(cell) else np.zeros(1, np.int64)
    if len(cell):
        together = np.repeat(np.add.reduceat(n, indptr[:-1]), np.diff(indptr))
        p, q = share(n, total[source]), share(together, np.int64(language))
        ahead = np.flatnonzero(p > q)
        value = weight(p[ahead], q[ahead])
        best = _best(source[ahead], value, top)
        for r in np.unique(source[ahead[best]]).tolist():
            of = best[source[ahead[best]] == r]
            yield names[r], "term", term[ahead[of]].tolist(), value[of]
        none = share(np.zeros(len(names), np.int64), total)
    step = max(1, BLOCK // max(1, len(names)))
    for low in range(0, len(names), step):
        high = min(low + step, len(names))
        sums = _pairs(source, p, indptr, none, low, high) if len(cell) else np.zeros((high - low, len(names)), np.int64)
        for r in range(low, high):
            others = np.arange(len(names)) != r
            yield names[r], "pair", names[others].tolist(), sums[r - low, others]


def audit(docs: DataFrame, top: int = TOP, in_documents: int = IN_DOCUMENTS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each source against its language and against the other sources.

    Part ``pair`` has a row for every other source of the language, part
    ``term`` the ``top`` terms that the source uses more than its language,
    each by falling value, then by item.  Null texts, languages and sources
    count as empty strings, repeated rows as documents of their own; a
    group without terms takes part with a count of 0 for each; a language
    without kept terms has pairs of value 0; an empty table gives no rows;
    other columns are not read.

    A task holds ``CELLS`` cells of a language's matrix and one row for each
    of its sources; the pairs of a language are as many as the result has.
    """
    cells = materialise(count_terms(docs), "terms")
    in_all = F.sum("n_docs").over(Window.partitionBy("lang", "term"))
    kept = materialise(cells.where("term is not null").withColumn("in_all", in_all).where(F.col("in_all") >= in_documents).drop("in_all", "n_docs"), "kept")
    terms = kept.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("all"), F.count("*").alias("cells"))
    # one row a language
    parts = max(1, -(-(terms.agg(F.max("cells")).first()[0] or 0) // CELLS))
    groups = cells.where("term is null").select("lang", "source").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left")
    sizes = groups.join(terms, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("own", "v", "all")))
    heads = sizes.select("lang", "source", (F.col("own") + F.col("v")).alias("n"))
    heads = heads.unionByName(sizes.groupBy("lang").agg(F.max(F.col("all") + F.col("v")).alias("n")).withColumn("source", F.lit(None).cast("string")))
    heads = heads.withColumn("term", F.lit(None).cast("string")).withColumn("stretch", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = kept.withColumn("stretch", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).unionByName(heads)

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def sums(table: pa.Table) -> pa.Table:
        lang, out = table.column("lang")[0].as_py(), []
        for source, part, items, values in _stretch(table.select(["source", "term", "n"]), top):
            k = len(items)
            out.append(pa.table([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array([part] * k, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    found = dealt.groupBy("lang", "stretch").applyInArrow(sums, "lang string, source string, part string, item string, value long")
    whole = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return whole.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
