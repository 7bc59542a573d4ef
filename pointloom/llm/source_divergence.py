"""How far each source's words are from its language's, and from each other source's of the language.

Chunk factorization: chunks of text between white space are counted per document inside each slice of rows, and the
slices' counts meet by chunk, sorted; so each globally distinct chunk is tokenized once, and its terms are joined to
its counts there and then. Occurrences and distinct documents are added up by term.

Whether a term is in enough documents of a language is decided exactly: a chunk in enough documents settles it for its
terms, and chunks whose documents together are too few settle it the other way. Only for the terms in between do the
documents of a term's spellings have to be told apart; each such chunk is in less than ``min_docs`` documents, and
carries them all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._common import documents, settle

#: ASCII letters and everything beyond ASCII; in UTF-8, once A-Z are lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[a-z\x80-\xff]+")
MIN_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
SLICE, PAIRS, ROWS = 1 << 24, 1 << 22, 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Counts of a chunk in a language: d documents; which ones, if they are few; each source's hash and occurrences.
_COUNTS = "lang string, d long, docs array<long>, source array<long>, n array<long>"


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where a run of rows that are equal in all columns begins."""
    new = np.zeros(max(0, len(cols[0]) - 1), bool)
    for c in cols:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(np.ones(min(1, len(cols[0])), bool), new))


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _codes(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = col.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def chunk_counts(rows: DataFrame, min_docs: int) -> DataFrame:
    """Counts of every chunk in each slice of rows (lang, source's hash, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for b in batches:
            for lo, hi, buf, at in W.slices(b.column("text"), SLICE):
                number += 1
                flat = W.flatten(buf, at, hashed=False)
                if not len(flat.start):
                    continue
                lang, langs = _codes(b.column("lang").slice(lo, hi - lo))
                source, sources = _codes(b.column("source").slice(lo, hi - lo))
                order = np.argsort(source, kind="stable")  # documents are numbered by source, so that a source's are together
                place = np.empty(flat.n, np.int64)
                place[order] = np.arange(flat.n)
                chunk, chunks = _codes(W.word_array(flat))
                key = (chunk * len(langs) + lang[flat.doc]) * flat.n + place[flat.doc]
                del flat, chunk
                key.sort()
                first = _starts(key)
                times = np.diff(np.append(first, len(key)))
                row, doc = np.divmod(key[first], len(order))
                del key
                of = source[order][doc]
                start, run = _starts(row), _starts(row, of)
                d = np.diff(np.append(start, len(row)))
                few = d < min_docs
                ids = (number << 24) + doc[np.repeat(few, d)]
                n = np.add.reduceat(times, run)
                at_docs, at_runs = np.append(0, np.cumsum(np.where(few, d, 0))), np.append(np.searchsorted(run, start), len(run))
                hashes = sources.to_numpy()[of[run]]
                for i in range(0, len(start), ROWS):
                    j = min(i + ROWS, len(start))
                    r, x, y = row[start[i:j]], at_docs[i : j + 1], at_runs[i : j + 1]
                    cols = [
                        chunks.take(pa.array(r // len(langs))).cast(pa.large_string()).cast(pa.string()), langs.take(pa.array(r % len(langs))), pa.array(d[i:j]),
                        _lists(x - x[0], ids[x[0] : x[-1]]), _lists(y - y[0], hashes[y[0] : y[-1]]), _lists(y - y[0], n[y[0] : y[-1]]),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=["chunk", "lang", "d", "docs", "source", "n"])

    return rows.mapInArrow(count, f"chunk string, {_COUNTS}")


def _merged(t: pa.Table, min_docs: int) -> pa.Table:
    """One row for each chunk and language of rows sorted by these."""
    t = t.combine_chunks()
    col = {c: t[c].chunk(0) for c in t.column_names}
    start = _starts(_codes(col["chunk"])[0], _codes(col["lang"])[0])
    if len(start) == len(t):
        return t
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(t))))
    d = np.add.reduceat(col["d"].to_numpy(), start)
    of = group[np.repeat(np.arange(len(t)), col["docs"].value_lengths().to_numpy())]
    few = d[of] < min_docs  # documents of a chunk that reaches the limit aren't needed, nor all there
    docs = col["docs"].flatten().to_numpy()[few]
    code, hashes = _codes(col["source"].flatten())
    key = group[np.repeat(np.arange(len(t)), col["source"].value_lengths().to_numpy())] * len(hashes) + code
    order = np.argsort(key, kind="stable")
    run = _starts(key[order])
    n, (row, source) = np.add.reduceat(col["n"].flatten().to_numpy()[order], run), np.divmod(key[order][run], len(hashes))
    ends = lambda x: np.append(0, np.cumsum(np.bincount(x, minlength=len(start))))
    keys = [col[c].take(pa.array(start)) for c in ("chunk", "lang")]
    return pa.table([*keys, pa.array(d), _lists(ends(of[few]), docs), _lists(ends(row), hashes.to_numpy()[source]), _lists(ends(row), n)], names=t.column_names)


def tokenize(chunk: str) -> list[str]:
    """Terms of a chunk, in order; only A-Z are lower-cased."""
    return [x.decode() for x in _TERM.findall(chunk.encode().lower())]


def chunk_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """term, and the counts of a chunk that has it: one row for each occurrence of a term in a distinct chunk and language."""

    def tokenized(t: pa.Table) -> Iterator[pa.RecordBatch]:
        code, chunks = _codes(t["chunk"].combine_chunks())
        terms = [tokenize(x) for x in chunks.to_pylist()]
        size = np.array([len(x) for x in terms], np.int64)[code]
        rows = pa.array(np.repeat(np.arange(len(t)), size))
        out = t.drop_columns("chunk").take(rows).add_column(0, "term", pa.array([x for c in code.tolist() for x in terms[c]], pa.string()))
        yield from out.combine_chunks().to_batches()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last chunk so far: more of its rows may follow
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = _merged(pa.concat_tables([held, t]) if held is not None else t, min_docs)
            code = _codes(t["chunk"].combine_chunks())[0]
            last = int(np.argmax(code == code[-1]))
            if last:
                yield from tokenized(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield from tokenized(held)

    return counts.repartition("chunk").sortWithinPartitions("chunk", "lang").mapInArrow(join, f"term string, {_COUNTS}")


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source (its 64-bit hash), term, n and lang_n (occurrences): terms in ``min_docs`` documents of a language.

    A row is a document. Null text, lang and source are read as ''.
    """
    lang, source, text = (F.coalesce(F.col(c), F.lit("")) for c in (lang_col, source_col, text_col))
    counts = chunk_counts(docs.select(lang.alias("lang"), F.xxhash64(source).alias("source"), text.alias("text")), min_docs)
    same = Window.partitionBy("lang", "term")
    spelled = chunk_terms(counts, min_docs).repartition("lang", "term").withColumns({"most": F.max("d").over(same), "all": F.sum("d").over(same)})
    # one list of what to add up: sources with occurrences and, where documents must be told apart, these
    parts = F.arrays_zip("source", "n", F.transform("source", lambda _: F.lit(None).cast("long")).alias("doc"))
    unsure = F.transform("docs", lambda x: F.struct(F.lit(None).cast("long").alias("source"), F.lit(0).cast("long").alias("n"), x.alias("doc")))
    items = F.concat(parts, F.when(F.col("most") < min_docs, unsure).otherwise(F.array()))
    each = spelled.filter(F.col("all") >= min_docs).select("lang", "term", "most", F.explode(items).alias("x")).select("lang", "term", "most", "x.*")
    summed = settle(each.groupBy("lang", "term", "source", "doc").agg(F.sum("n").alias("n"), F.max("most").alias("most")), "term-counts")
    kept = summed.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.max("most").alias("m"), F.count("doc").alias("k"))
    kept = kept.filter(F.greatest("m", "k") >= min_docs).select("lang", "term", "lang_n")
    return summed.filter("source is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"])


def _p(n: Column, total: Column, terms: Column, scale: int) -> Column:
    """1 + floor(scale * (n + 2) / (total + 2 * terms)) in whole numbers."""
    over = F.lit(scale).cast("decimal(12,0)") * (n + 2).cast("decimal(20,0)")
    return 1 + F.call_function("div", over, (total + 2 * terms).cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(terms: DataFrame, held: int = PAIRS) -> DataFrame:
    """lang, i, j (i < j), v: f of sources i and j of a language, summed over all terms.

    ``terms``: lang, p0 (each source's p of a term that it hasn't) and has (r, p: the sources that have the term). Sums
    are whole numbers, held for as many pairs as ``held`` and then handed on, to be added up.
    """
    schema = "lang string, i int, j int, v long"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, m in sums.items():
                i, j = np.triu_indices(len(m), 1)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], names=["lang", "i", "j", "v"])
            sums.clear()

        for b in batches:
            coded = b.column("lang").dictionary_encode()
            code = coded.indices.to_numpy()
            for c, lang in enumerate(coded.dictionary.to_pylist()):
                rows = b.filter(pa.array(code == c))
                base = np.array(rows.column("p0")[0].as_py(), np.int64)
                step = max(1, (1 << 20) // len(base))
                if lang not in sums and sum(m.size for m in sums.values()) + base.size**2 > held:
                    yield from flush()
                m = sums.setdefault(lang, np.zeros((len(base), len(base)), np.int64))
                for lo in range(0, rows.num_rows, step):
                    has = rows.column("has").slice(lo, step)
                    p = np.tile(base, (len(has), 1))
                    flat = has.flatten()
                    of = np.repeat(np.arange(len(has)), has.value_lengths().to_numpy())
                    p[of, flat.field("r").to_numpy()] = flat.field("p").to_numpy()
                    for i in range(len(base) - 1):
                        d = p[:, i + 1 :] - p[:, i : i + 1]
                        m[i, i + 1 :] += (d * d // (p[:, i + 1 :] + p[:, i : i + 1])).sum(0)
        yield from flush()

    return terms.select("lang", "p0", "has").mapInArrow(add, schema).groupBy("lang", "i", "j").agg(F.sum("v").alias("v"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, scale: int = SCALE, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: what sets each source of a language apart.

    A language's terms are those in ``min_docs`` of its documents or more. p is a term's smoothed share, in parts of
    ``scale``, of a source's terms or of its language's; f = floor((p-q)**2 / (p+q)). Part 'pair' has each other source of
    the language with f summed over all terms, all ranks; part 'term' the ``top`` terms that the source has and uses
    more than its language does, by f. Greater values rank first; ties by item.

    A row is a document, repeated ones too. Null text, lang or source is ''. A source without terms has pairs, with what
    smoothing gives; where a language has no terms they have the value 0. A language with one source has no pairs; an
    empty table gives an empty one; other columns of any name are ignored. Very long texts are counted whole.
    """
    counts = settle(term_counts(docs, min_docs, lang_col, source_col, text_col), "kept-terms")
    langs = counts.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    seen = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "name"))]).distinct().withColumn("source", F.xxhash64("name"))
    groups = seen.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.withColumn("source", F.col("name")).withColumn("code", F.xxhash64("name")).drop("name").na.fill(0, ["total", "v", "lang_total"]).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = settle(groups.withColumn("p0", F.when(F.col("v") > 0, _p(F.lit(0), F.col("total"), F.greatest("v", F.lit(1)), scale))), "sources")

    shares = counts.withColumnRenamed("source", "code").join(groups, ["lang", "code"]).withColumn("p", _p(F.col("n"), F.col("total"), F.col("v"), scale))
    q = _p(F.col("lang_n"), F.col("lang_total"), F.col("v"), scale)
    more = shares.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    base = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "p0"))), lambda x: x["p0"]).alias("p0"))
    sums = pair_sums(shares.groupBy("lang", "term").agg(F.collect_list(F.struct("r", "p")).alias("has")).join(base, "lang"))
    a, b = groups.select("lang", "source", "r"), groups.select("lang", F.col("source").alias("item"), F.col("r").alias("s"))
    pairs = a.join(b, "lang").filter("r != s").withColumns({"i": F.least("r", "s"), "j": F.greatest("r", "s")}).join(sums, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("v", F.lit(0)).alias("value")).withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(more).withColumns({"value": F.col("value").cast("long"), "rank": F.col("rank").cast("int")})


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


OP12_SQL = rf"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as ts from documents),
t as (select i, lang, source, unnest(ts) as term from d),
k as (select lang, term, count(*) as lang_n from t group by lang, term having count(distinct i) >= {MIN_DOCS}),
l as (select lang, count(*) as v, sum(lang_n) as total from k group by lang),
s as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t join k using (lang, term) group by lang, source, term),
g as (select lang, source, sum(n) as total from c group by lang, source),
p as (select s.lang, s.source, k.term, coalesce(n, 0) as n, (1 + {SCALE}::hugeint * (coalesce(n, 0) + 2) // (coalesce(g.total, 0) + 2 * l.v))::bigint as p, (1 + {SCALE}::hugeint * (lang_n + 2) // (l.total + 2 * l.v))::bigint as q
 from s join k using (lang) join l using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = k.term left join g on g.lang = s.lang and g.source = s.source),
y as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
z as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from s a join s b on a.lang = b.lang and a.source <> b.source left join y on y.lang = a.lang and y.source = a.source and y.item = b.source
 union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from p where n > 0 and p > q)
select * from (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from z) where part = 'pair' or rank <= {TOP}
"""
