"""A search index that is built once, in batches that outlive a broken build, and that questions are answered from.

A build has a specification: how rows become terms, which columns are kept, and the listing of its source's files. It is
written first, and a later call with another one is refused. A batch is a number of source files; its tables count as done once
Spark has committed them, so that a build that is called again goes on where the last one stopped. At the end all batches become

    documents   row, dl (number of terms) and the kept columns
    terms       term, df, sorted
    postings    term, row, dl, tf, in ranges of (term, row), sorted: a question reads the row groups of its terms

and a manifest with the specification, totals and each table's listing, which is what makes the index exist. A reader
refuses an index whose specification isn't the one it expects or whose files aren't those of the manifest.

With ``runs`` (and always with places) postings stay in the batches' files, runs sorted by term, each with the rows of the documents it has (term null) before
it: texts are read once, postings are written once and never shuffled, and a question reads the row groups of its terms in each run. Terms are then no
table: they are counted from the postings of those that are asked for.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.filters import ranked
from ..sources import store
from .retrieval import K1, MOST_PARTICLES, PARTICLE_WEIGHT, B

#: Fills up the last trigrams of a text, so that each character begins one.
PAD = "\u0000"


#: How a text becomes terms; for trigrams, the text whose characters each begin one (it and the next two).
RECIPES: dict[str, Callable[[Column], Column]] = {"tokens": T.tokens, "analyzer": lambda c: T.analyzed(T.nfkc_casefold(c)), "trigrams": F.lower}
TABLES = ("documents", "terms", "postings")
#: Bytes of a row group of postings: small, so that few terms are read beside those asked for.
GROUP_BYTES = 4 << 20
#: Terms that are counted at once, in whole texts: what a task has in memory.
PIECE = 2_000_000


@dataclass(frozen=True)
class Spec:
    """What an index is made of. ``version`` is the user's; another one is another index."""

    version: str
    row: str
    text: str
    kept: tuple[str, ...] = ()
    recipe: str = "tokens"
    files_per_batch: int = 64
    places: bool = False  # postings have the terms' places in the text, in order
    runs: bool = False  # postings stay where their texts are

    @property
    def in_runs(self) -> bool:
        return self.runs or self.places


def full_spec(spark: SparkSession, source: str, spec: Spec) -> dict:
    """The specification with the listing of the source as it is now."""
    if spec.recipe not in RECIPES:
        raise ValueError(f"no recipe {spec.recipe}")
    return {**asdict(spec), "kept": list(spec.kept), "format": 3, "source": store.listing_digest(store.data_files(spark, source))}


def digest(full: dict) -> str:
    return hashlib.sha256(json.dumps(full, sort_keys=True).encode()).hexdigest()


def commit_once(df: Callable[[], DataFrame], path: str, spark: SparkSession, **options: object) -> bool:
    """Write a table unless it is there whole; what a broken job left is replaced. True if it was written now."""
    if store.exists(spark, f"{path}/_SUCCESS"):
        return False
    df().write.mode("overwrite").options(**options).parquet(path)
    return True


def _in_trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """A key for what begins at each character of each text, how many each text has, and the terms of sorted different keys."""
    given = texts.to_pylist()
    sizes = np.array([len(t) for t in given], np.int64)
    points = np.frombuffer("".join(t + PAD * 2 for t in given).encode("utf-32-le"), "<u4").astype(np.int64)
    keys = np.zeros(len(points), np.int64)
    keys[:-2] = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    begins = np.ones(len(points), bool)
    ends = np.cumsum(sizes + 2)
    begins[ends - 1] = begins[ends - 2] = False

    def terms(different: np.ndarray) -> pa.Array:
        parts = np.stack([different >> 42, different >> 21 & 0x1FFFFF, different & 0x1FFFFF], axis=1).astype("<u4")
        joined = parts.tobytes().decode("utf-32-le")
        return pa.array([joined[k : k + 3] for k in range(0, len(joined), 3)], pa.string())

    return keys[begins], sizes, terms


def _in_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """As :func:`_in_trigrams`, of lists of terms."""
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return rank[coded.indices.to_numpy(zero_copy_only=False)], sizes, lambda different: coded.dictionary.take(pa.array(order[different]))


def _in_pairs(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """As :func:`_in_lists`, of lists of words, each followed by its neighbours as one term each (:func:`~lodestone.functions.text.bigrams`).

    No word has a character before the space, so terms are in the order of their first and second words.
    """
    words, n, _ = coded = _in_lists(lists)
    base = int(words.max(initial=-1)) + 2
    sizes = n + np.maximum(n - 1, 0)
    starts, before = np.cumsum(sizes) - sizes, np.cumsum(n) - n
    keys = np.empty(int(sizes.sum()), np.int64)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(words)) - before[text]
    keys[starts[text] + at] = words * base
    second = np.flatnonzero(at > 0)
    keys[(starts + n)[text[second]] + at[second] - 1] = words[second - 1] * base + words[second] + 1

    def terms(different: np.ndarray) -> pa.Array:
        firsts, seconds = coded[2](different // base), coded[2](np.maximum(different % base - 1, 0))
        return pc.if_else(pa.array(different % base == 0), firsts, pc.binary_join_element_wise(firsts, seconds, " "))

    return keys, sizes, terms


def _postings(rows: pa.Array, content: pa.Array, names: list[str], places: bool, pairs: bool = False) -> pa.RecordBatch:
    """term, row, dl, tf and, if asked for, places of whole texts, by (term, text)."""
    keys, sizes, terms = (_in_pairs if pairs else _in_lists if pa.types.is_list(content.type) else _in_trigrams)(content)
    order = np.argsort(keys, kind="stable")  # terms stand by text and place, and stay so
    sorted_keys, text = keys[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    other = np.ones(len(order), bool)
    other[1:] = sorted_keys[1:] != sorted_keys[:-1]
    first = other.copy()
    first[1:] |= text[1:] != text[:-1]
    starts = np.flatnonzero(first)
    ends = np.append(starts, len(order))
    of_term, of_text = np.cumsum(other)[starts] - 1, text[starts]
    columns = [terms(sorted_keys[other]).take(pa.array(of_term)), rows.take(pa.array(of_text)), pa.array(sizes[of_text], pa.int32()), pa.array(np.diff(ends), pa.int32())]
    if places:
        at = order - (np.cumsum(sizes) - sizes)[text]
        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32())))
    return pa.RecordBatch.from_arrays(columns, names)


def _of_batch(docs: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """Documents and postings. A text's terms are counted where the text is, so nothing is shuffled; each run of output is sorted by term.

    With runs, postings have the documents' rows as well (term null), which are all that has kept columns.
    """
    pairs = spec.recipe == "analyzer"  # neighbours are put together where they are counted
    text = F.coalesce(F.col(spec.text), F.lit(""))
    content = T.analyzed_words(T.nfkc_casefold(text)) if pairs else RECIPES[spec.recipe](text)
    size = (F.length if spec.recipe == "trigrams" else F.size)("terms")
    size = size + F.greatest(size - 1, F.lit(0)) if pairs else size
    named = docs.select(F.col(spec.row).alias("row"), *spec.kept, content.alias("terms"))
    kept = spec.kept if spec.in_runs else ()
    rows = named.select("row", "terms", *kept)
    shape = f"term string, row {rows.schema['row'].dataType.simpleString()}, dl int, tf int" + (", places array<int>" if spec.places else "")
    shape += "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    names = ["term", "row", "dl", "tf"] + ["places"] * spec.places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = batch.column(1)
            lengths = pc.list_value_length(content) if pa.types.is_list(content.type) else pc.utf8_length(content)
            n_terms = lengths.to_numpy(zero_copy_only=False).astype(np.int64)
            n_terms = n_terms + np.maximum(n_terms - 1, 0) if pairs else n_terms
            piece = np.cumsum(n_terms) // PIECE
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    found = _postings(batch.column(0).slice(a, b - a), content.slice(a, b - a), names, spec.places, pairs)
                    if not spec.in_runs:
                        yield found
                        continue
                    own = [batch.column(2 + i).slice(a, b - a) for i in range(len(kept))]
                    n = b - a
                    of_docs = [pa.nulls(n, pa.string()), batch.column(0).slice(a, n), pa.array(n_terms[a:b], pa.int32()), pa.array(np.zeros(n, np.int32))]
                    yield pa.RecordBatch.from_arrays([*of_docs, *[pa.nulls(n, pa.list_(pa.int32()))] * spec.places, *own], [*names, *kept])
                    yield pa.RecordBatch.from_arrays([*found.columns, *[pa.nulls(found.num_rows, c.type) for c in own]], [*names, *kept])

    return named.select("row", size.alias("dl"), *spec.kept), rows.mapInArrow(run, shape)


def _tables(path: str, runs: bool) -> dict[str, str]:
    """Where the tables are; runs are the batches' own, and terms none."""
    return {"documents": f"{path}/documents", "postings": f"{path}/batches/postings"} if runs else {name: f"{path}/{name}" for name in TABLES}


def build_index(spark: SparkSession, source: str, path: str, spec: Spec) -> list[str]:
    """Build the index of a Parquet table, or what of it is missing; the names of the tables written now.

    Rows are told apart by ``spec.row``, which must be unique and not null; null text has no terms.
    """
    full = full_spec(spark, source, spec)
    if not store.put_new(spark, f"{path}/build.json", json.dumps(full, sort_keys=True)):
        begun = json.loads(store.read_text(spark, f"{path}/build.json"))
        if begun != full:
            changed = sorted(k for k in full.keys() | begun.keys() if full.get(k) != begun.get(k))
            raise ValueError(f"the build's specification changed ({', '.join(changed)}); use a new folder")
    if store.exists(spark, f"{path}/manifest.json"):
        return []
    files = [f.path for f in store.data_files(spark, source)]
    made, batches = [], [files[k : k + spec.files_per_batch] for k in range(0, len(files), spec.files_per_batch)]
    for k, batch in enumerate(batches):
        documents, postings = _of_batch(spark.read.parquet(*batch), spec)
        for name, df in (("documents", documents), ("postings", postings))[spec.in_runs :]:
            if commit_once(lambda df=df: df, f"{path}/batches/{name}/{k:06}", spark, **{"parquet.block.size": GROUP_BYTES}):
                made.append(f"{name}/{k:06}")
    whole = lambda name: spark.read.parquet(*[f"{path}/batches/{name}/{k:06}" for k in range(len(batches))])
    if spec.in_runs:
        final = {"documents": lambda: whole("postings").filter("term IS NULL").select("row", "dl", *spec.kept)}
    else:
        final = {
            "documents": lambda: whole("documents"),
            "terms": lambda: whole("postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")).repartitionByRange("term").sortWithinPartitions("term"),
            "postings": lambda: whole("postings").repartitionByRange("term", "row").sortWithinPartitions("term", "row"),
        }
    for name, df in final.items():
        if commit_once(df, f"{path}/{name}", spark, **{"parquet.block.size": GROUP_BYTES}):
            made.append(name)
    n, total = spark.read.parquet(f"{path}/documents").agg(F.count(F.lit(1)), F.sum("dl")).first()
    listings = {name: store.data_files(spark, at) for name, at in _tables(path, spec.in_runs).items()}
    manifest = {"spec": full, "n": n, "average": total / n if n else 0.0, "tables": {name: {"files": len(x), "bytes": sum(f.bytes for f in x), "listing": store.listing_digest(x, changed=False)} for name, x in listings.items()}}
    store.put_new(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return made


class StaleIndex(ValueError):
    pass


class Index:
    """An index that was checked against what its reader expects."""

    def __init__(self, spark: SparkSession, path: str, expected: dict):
        found = store.read_text(spark, f"{path}/manifest.json")
        if found is None:
            raise StaleIndex(f"no whole index in {path}")
        self.spark, self.path, self.manifest = spark, path, json.loads(found)
        if wrong := sorted(k for k, v in expected.items() if self.manifest["spec"].get(k) != v):
            raise StaleIndex(f"the index has another {', '.join(wrong)}")
        self.tables = _tables(path, self.manifest["spec"]["runs"] or self.manifest["spec"]["places"])
        for name, at in self.tables.items():
            if store.listing_digest(store.data_files(spark, at), changed=False) != self.manifest["tables"][name]["listing"]:
                raise StaleIndex(f"files of {name} aren't those of the manifest")
        self.n, self.average = self.manifest["n"], self.manifest["average"]

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:  # terms of runs; a filter of terms reaches the scan
            return self.table("postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        at = self.tables[name]
        if "/batches/" not in at:
            return self.spark.read.parquet(at)
        found = self.spark.read.option("recursiveFileLookup", "true").parquet(at)
        return found.filter(F.col("term").isNotNull()).drop(*self.manifest["spec"]["kept"])

    def postings(self, wanted: Sequence[str]) -> DataFrame:
        """Postings of the given terms; the filter reaches the scan."""
        return self.table("postings").filter(F.col("term").isin(*wanted))

    def analyzed(self, text: str) -> list[str]:
        """Terms of a question, by the index's own recipe."""
        return self.spark.range(1).select(RECIPES[self.manifest["spec"]["recipe"]](F.lit(text)).alias("t")).first()["t"]

    def weighted_terms(self, weighted: Sequence[tuple[str, float]], particles: bool = False) -> list[tuple[str, int, float]]:
        """term, df and weight of the index terms that a question's terms stand for, weights added up.

        With ``particles`` also terms of one or two more characters, the first MOST_PARTICLES of each in order, at PARTICLE_WEIGHT; so few rows that
        they are the driver's. :meth:`bm25_of_all` takes all of them.
        """
        asked = sorted({t for t, _ in weighted})
        if not asked:
            return []
        terms = self.table("terms")
        df = {r["term"]: r["df"] for r in terms.filter(F.col("term").isin(*asked)).collect()}
        total: dict[str, float] = {}
        for t, w in weighted:
            if t in df:
                total[t] = total.get(t, 0.0) + w
        if particles and (short := _that_grow(asked)):
            grown = terms.filter(reduce(or_, [_longer(F.col("term"), F.lit(q)) for q in short]))  # one pass for all
            of_each = grown.withColumn("q", F.explode(F.filter(F.array(*map(F.lit, short)), lambda q: _longer(F.col("term"), q))))
            for r in ranked(of_each, [F.col("term")], MOST_PARTICLES, ["q"]).collect():
                df[r["term"]] = r["df"]
                total[r["term"]] = total.get(r["term"], 0.0) + PARTICLE_WEIGHT * sum(w for t, w in weighted if t == r["q"])
        return sorted((t, df[t], w) for t, w in total.items())

    def bm25_of_all(self, weighted: Sequence[tuple[str, float]]) -> DataFrame:
        """row and score as by :meth:`bm25`, with all terms of one or two more characters, at PARTICLE_WEIGHT.

        How many these are is the index's affair, so they stay a table: a term's weight is an expression of it, and its df is joined.
        """
        if not weighted:
            return self.bm25([])
        term, short = F.col("term"), set(_that_grow([t for t, _ in weighted]))
        meant = {q: (term == q, _longer(term, F.lit(q)) if q in short else F.lit(False)) for q, _ in weighted}
        weight = reduce(add, [F.when(meant[q][0], w).when(meant[q][1], PARTICLE_WEIGHT * w).otherwise(0.0) for q, w in weighted])
        near = reduce(or_, [F.startswith(term, F.lit(q)) if q in short else term == q for q in meant])  # a filter that reaches the scan
        wanted = reduce(or_, [same | longer for same, longer in meant.values()])
        df, postings = (self.table(name).filter(near).filter(wanted) for name in ("terms", "postings"))
        idf = F.log1p((F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return postings.join(df, "term").groupBy("row").agg(F.sum(self._share(weight * idf, K1, B)).alias("score"))

    def bm25(self, terms: Sequence[tuple[str, int, float]], k1: float = K1, b: float = B) -> DataFrame:
        """row and score from the postings of weighted terms (:meth:`weighted_terms`)."""
        if not terms:
            return self.table("documents").limit(0).select("row", F.lit(0.0).alias("score"))
        idf = [(t, w * _idf(self.n, df)) for t, df, w in terms]
        weight = F.create_map(*[F.lit(x) for pair in idf for x in pair])[F.col("term")]
        return self.postings([t for t, _, _ in terms]).groupBy("row").agg(F.sum(self._share(weight, k1, b)).alias("score"))

    def _share(self, weight: Column, k1: float, b: float) -> Column:
        return weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(self.average or 1.0)))

    def starts(self, word: str) -> DataFrame:
        """row and starts (in order, from 0) of all places of a word in the lower-cased texts, overlapping ones too; for an index of trigrams with places.

        Trigrams that cover the word are looked up, and their places moved to where the word would begin must have some in
        common. A word of one or two characters is what trigrams begin with. So no text is read for words of any length.
        """
        spec = self.manifest["spec"]
        if spec["recipe"] != "trigrams" or not spec["places"]:
            raise ValueError("the index has no places of trigrams")
        w = word.lower()
        if not w or PAD in w:
            raise ValueError("a word has characters, and no U+0000")
        if len(w) < 3:
            short = self.table("postings").filter(F.startswith("term", F.lit(w)))
            return short.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("starts"))
        cover = {k: w[k : k + 3] for k in sorted({*range(0, len(w) - 2, 3), len(w) - 3})}
        terms = sorted(set(cover.values()))
        if len(cover) == 1:  # a row has one posting of it
            return self.postings(terms).select("row", F.col("places").alias("starts"))
        held = self.postings(terms).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("m")).filter(F.size("m") == len(terms))
        moved = [_moved(F.col("m")[term], k) for k, term in cover.items()]
        common = moved[0]
        for more in moved[1:]:
            common = F.array_intersect(common, more)
        return held.select("row", F.array_sort(common).alias("starts")).filter(F.size("starts") > 0)

    def occurrences(self, words: Sequence[str]) -> DataFrame:
        """row and hits of the rows that have all words: how often they occur in all, each without overlaps."""
        every = None
        for i, word in enumerate(dict.fromkeys(w.lower() for w in words)):
            one = self.starts(word).select("row", F.lit(i).alias("word"), _without_overlaps(F.col("starts"), len(word)).alias("n"))
            every, n = one if every is None else every.unionByName(one), i + 1
        if every is None:
            raise ValueError("no words")
        return every.groupBy("row").agg(F.count(F.lit(1)).alias("words"), F.sum("n").cast("bigint").alias("hits")).filter(F.col("words") == n).drop("words")


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - F.lit(by))


def _without_overlaps(starts: Column, size: int) -> Column:
    """How many of the sorted places of a word of ``size`` characters are left if each begins behind the end of the one before."""
    none = F.struct(F.lit(0).alias("free"), F.lit(0).alias("n"))
    step = lambda s, p: F.when(p >= s["free"], F.struct((p + size).alias("free"), (s["n"] + 1).alias("n"))).otherwise(s)
    return F.aggregate(starts, none, step, lambda s: s["n"])


def _that_grow(asked: Sequence[str]) -> list[str]:
    """Words of a question that longer terms stand for, too."""
    return [q for q in asked if len(q) >= 2 and " " not in q]


def _longer(term: Column, q: Column) -> Column:
    """Is it the word and one or two more characters?"""
    return F.startswith(term, q) & (F.length(term) - F.length(q)).between(1, 2) & ~F.contains(term, F.lit(" "))


def _idf(n: int, df: int) -> float:
    return math.log1p((n - df + 0.5) / (df + 0.5))


def open_index(spark: SparkSession, source: str, path: str, spec: Spec) -> Index:
    """The index of a table as it is now; StaleIndex if the one in ``path`` is of another specification or source, or not whole."""
    return Index(spark, path, full_spec(spark, source, spec))


def ensure_index(spark: SparkSession, source: str, folder: str, spec: Spec) -> Index:
    """The index of a table in its own folder below ``folder``, built first where it isn't there yet."""
    path = f"{folder.rstrip('/')}/{digest(full_spec(spark, source, spec))[:24]}"
    build_index(spark, source, path, spec)
    return open_index(spark, source, path, spec)
