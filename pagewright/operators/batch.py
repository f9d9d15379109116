"""Hybrid search for a table of queries: every lane for all queries at once.

queries: qid, document_id, query, embedding (of its text) and kind (null: as the query's words say). chunks: as for ``retrieval.hybrid``, of many
documents. Each query is asked of its document's chunks, and gets what ``hybrid`` gives for it alone:

* section: the words and section numbers of a document's queries are broadcast in passes of bounded size. A chunk looks its own strings up among them, so its cost doesn't grow
  with the number of queries; tasks gather which chunks have which word, and keep k rows for each query.
* semantic, formula, table: query vectors are broadcast in passes of bounded size, by document; tasks multiply matrices and keep k rows for each query.
* keyword: the queries' terms are broadcast in passes of bounded size and counted where the texts are, a row for each chunk; tasks weigh the counts by the statistics of each
  document, add rows of weights and keep k rows for each query.

Chunks are dealt by ranges of document and id, so that a task meets few documents and the k rows of a query come from few tasks. Queries without qid or document are left out;
qids are distinct. No pair of a query and a chunk that doesn't match is ever a row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens, query_type, section_numbers, terms
from ..sources import store
from .retrieval import B, K1, LANES, Best, reciprocal_rank_fusion


def _first(rows: DataFrame, k: int, *order) -> DataFrame:
    # a plain bound on the row number lets tasks drop all but k rows of a query before the shuffle
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (document_id, id, ...) in tasks that hold neighbours."""
    return rows.repartitionByRange(max(12, 3 * rows.sparkSession.sparkContext.defaultParallelism), "document_id", "id")


class _Names:
    """The chunks of a document that a task has met, by the words and section numbers of the document's queries that they have.

    asked: the qids of each (tokens, sections, whole query). A word is looked up at every place of a text by its first three characters and the lengths of words that begin so."""

    def __init__(self, asked: dict[tuple, list]):
        self.asked = asked
        self.words = {w for tokens, _, low in asked for w in (*tokens, low) if w}
        lengths: dict[str, set[int]] = {}
        for w in self.words:
            lengths.setdefault(w[:3], set()).add(len(w))
        self.lengths = {begin: sorted(n) for begin, n in lengths.items()}
        self.sections = {x for _, sections, _ in asked for x in sections}
        self.sizes = sorted({len(x) for x in self.sections})
        self.clear()

    def clear(self) -> None:
        self.pages: list = []
        self.ids: list = []
        self.having: dict[tuple[int, str], list[int]] = {}
        self.waiting = 0

    def _within(self, text: str, found: set) -> None:
        for i in range(len(text) - 2):
            for n in self.lengths.get(text[i : i + 3], ()):
                if (w := text[i : i + n]) in self.words:
                    found.add((0, w))

    def _numbered(self, section: str, node: str, topic: str, head: str, found: set) -> None:
        starts = [i for i, c in enumerate(head) if c in " \n"]
        names = [section, *(node[:n] for n in self.sizes), *(topic[:n] for n in self.sizes if topic[n : n + 1] in (" ", ".")), *(head[i - n : i] for i in starts for n in self.sizes if i >= n)]
        found.update((1, x) for x in names if x in self.sections)

    def add(self, rows: pd.DataFrame) -> None:
        columns = [rows[c].tolist() for c in ("page_start", "id", "lt", "ll", "section_id", "node_id", "topic", "head")]
        for page, own, lt, ll, section, node, topic, head in zip(*columns, strict=True):
            found: set = set()
            self._within(lt, found)
            self._within(ll, found)
            if self.sizes:
                self._numbered(section, node, topic, head, found)
            if found:
                for x in found:
                    self.having.setdefault(x, []).append(len(self.ids))
                self.pages.append(page)
                self.ids.append(own)
                self.waiting += len(found)

    def best(self, k: int) -> pd.DataFrame:
        """The k rows that each query names best, of those met since the last call."""
        rows = pd.DataFrame({"page_start": np.array(self.pages, np.float64), "id": self.ids}).sort_values(["page_start", "id"])
        place = np.empty(len(rows), np.int64)
        place[rows.index.to_numpy()] = np.arange(len(rows))
        having = {x: np.sort(place[own]) for x, own in self.having.items()}
        qids: list = []
        picked, overlaps = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for (tokens, sections, low), own in self.asked.items():
            hits = [having[x] for t in tokens if (x := (0, t)) in having]
            named = [having[x] for x in (*((1, n) for n in sections), (0, low)) if x in having]
            if len(hits) == 1 and not named:
                pick = hits[0][:k]
                overlap = np.ones(len(pick), np.int64)
            elif hits or named:
                at = np.concatenate(hits + named)
                at, same = np.unique(at, return_inverse=True)
                overlap = np.bincount(same, np.repeat([1, 0], [sum(map(len, hits)), sum(map(len, named))])).astype(np.int64)
                first = np.lexsort((at, -overlap))[:k]
                pick, overlap = at[first], overlap[first]
            else:
                continue
            for qid in own:
                qids += [qid] * len(pick)
                picked.append(pick)
                overlaps.append(overlap)
        rows = rows.iloc[np.concatenate(picked)]
        self.clear()
        return pd.DataFrame({"qid": qids, "overlap": np.concatenate(overlaps), "page_start": rows["page_start"].to_numpy(), "id": rows["id"].to_numpy()})


def section_lanes(chunks: DataFrame, queries: DataFrame, k: int, block: int = 1_000_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """qid, id, rank of the k chunks of its document that each query names best. A task keeps k rows of each query whenever it has met block pairs of a chunk and a word."""
    text = F.coalesce("query", F.lit(""))
    asked = queries.select("document_id", "qid", section_numbers(text).alias("sections"), content_tokens(text).alias("tokens"), F.lower(text).alias("low"))
    # a text that has the whole query has each of its tokens: the query itself decides only where it has none
    asked = asked.withColumn("low", F.when((F.size("tokens") == 0) & (F.length("low") >= 4), F.col("low")).otherwise("")).where("size(sections) > 0 or size(tokens) > 0 or low <> ''")
    topic, title = F.coalesce("topic", F.lit("")), F.coalesce("title", F.lit(""))
    own = lambda c: F.coalesce(c, F.lit("")).alias(c)
    slim = chunks.select("document_id", "id", F.col("page_start").cast("double").alias("page_start"), own("section_id"), own("node_id"), topic.alias("topic"), F.lower(topic).alias("lt"), F.lower(title).alias("ll"), F.left(F.coalesce("search_text", F.lit("")), F.lit(200)).alias("head"))
    spark = chunks.sparkSession
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "qid"), (chunks, "id"))}
    schema = f"qid {kinds['qid']}, overlap long, page_start double, id {kinds['id']}"
    size = asked.agg(F.sum(64 + F.length("low") + 16 * (F.size("sections") + F.size("tokens"))).alias("n")).first()["n"]
    passes = -(-(size or 0) // broadcast_bytes)

    def held(number: int):
        by: dict = {}
        for q in asked.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == number).toArrow().to_pylist():
            by.setdefault(q["document_id"], {}).setdefault((tuple(q["tokens"]), tuple(q["sections"]), q["low"]), []).append(q["qid"])
        return spark.sparkContext.broadcast(by)

    def named(by):
        def run(frames):
            met: dict = {}
            for frame in frames:
                for document, some in frame.groupby("document_id", sort=False):
                    if document not in by.value:
                        continue
                    if document not in met:
                        met[document] = _Names(by.value[document])
                    for low in range(0, len(some), 1024):
                        met[document].add(some.iloc[low : low + 1024])
                        if sum(x.waiting for x in met.values()) > block:
                            yield from (x.best(k) for x in met.values() if x.waiting)
            yield from (x.best(k) for x in met.values() if x.waiting)

        return run

    found = [spark.createDataFrame([], schema)]
    for number in range(passes):
        by = held(number)
        one = _dealt(slim).mapInPandas(named(by), schema)
        if passes > 1:
            one = store.written(one, "named")  # so that no two passes hold their queries at once
            by.destroy()
        found.append(one)
    return _first(reduce(DataFrame.unionByName, found), k, F.desc("overlap"), F.asc_nulls_last("page_start"), "id").select("qid", "id", "rank")


def _counted(chunks: DataFrame, pairs: DataFrame, analyzer, broadcast_bytes: int) -> DataFrame:
    """A row for each chunk: document_id, id, n (its words), of (rows that have the id), total (their words), p (term and count of each of its document's pairs that occurs)."""
    spark = chunks.sparkSession
    words = chunks.select("document_id", F.col("id").cast("string").alias("id"), F.coalesce(analyzer(F.col("search_text")), F.array().cast("array<string>")).alias("w"))
    size = pairs.agg(F.sum(16 + F.length("document_id") + F.length("term")).alias("n")).first()["n"]
    passes = max(1, -(-(size or 0) // broadcast_bytes))

    def held(number: int):
        own = pairs.where(F.pmod(F.xxhash64("document_id", "term"), F.lit(passes)) == number).toArrow()
        documents, terms = (own.column(c).combine_chunks().unique() for c in ("document_id", "term"))
        number_of = lambda c, values: pc.index_in(own.column(c).combine_chunks(), value_set=values).to_numpy(zero_copy_only=False).astype(np.int64)
        return spark.sparkContext.broadcast((documents, terms, np.sort(number_of("document_id", documents) * max(1, len(terms)) + number_of("term", terms))))

    def count(by, first: bool):
        def run(batches):
            documents, terms, known = by.value
            width = max(1, len(terms))
            for batch in batches:
                for low in range(0, batch.num_rows, 1024):
                    some = batch.slice(low, 1024)
                    n = pc.list_value_length(some.column("w")).to_numpy(zero_copy_only=False).astype(np.int64)
                    code = pc.fill_null(pc.index_in(some.column("w").flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(len(n)), n)[code >= 0]
                    key, tf = np.unique(row * width + code[code >= 0], return_counts=True)
                    row, code = np.divmod(key, width)
                    document = pc.fill_null(pc.index_in(some.column("document_id"), value_set=documents), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                    wanted = document[row] * width + code
                    at = np.minimum(np.searchsorted(known, wanted), max(0, len(known) - 1))
                    there = (document[row] >= 0) & (known[at] == wanted) if len(known) else np.zeros(len(row), bool)
                    row, code, tf = row[there], code[there], tf[there]
                    p = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32()), pa.StructArray.from_arrays([terms.take(pa.array(code)), pa.array(tf, pa.float64())], ["term", "tf"]))
                    of = pa.array(np.full(len(n), int(first)), pa.int64())
                    yield pa.RecordBatch.from_arrays([some.column("document_id"), some.column("id"), pa.array(n), of, pa.array(n * int(first)), p], ["document_id", "id", "n", "of", "total", "p"])

        return run

    found = []
    for number in range(passes):
        by = held(number)
        found.append(store.written(words.mapInArrow(count(by, number == 0), "document_id string, id string, n long, of long, total long, p array<struct<term string, tf double>>"), "counted"))
        by.destroy()
    rows = _dealt(reduce(DataFrame.unionByName, found)).groupBy("document_id", "id")
    return rows.agg(F.max("n").alias("n"), F.sum("of").alias("of"), F.sum("total").alias("total"), F.flatten(F.collect_list("p")).alias("p"))


def keyword_lanes(chunks: DataFrame, queries: DataFrame, k: int, analyzer=terms, block: int = 1024, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """qid, id, rank of the k chunks of its document with every term of each query, by BM25 over the document."""
    wanted = queries.select("document_id", "qid", F.array_distinct(analyzer(F.coalesce("query", F.lit("")))).alias("t")).where(F.size("t") > 0)
    pairs = wanted.select("document_id", F.explode("t").alias("term")).distinct()
    rows = store.written(_counted(chunks, pairs, analyzer, broadcast_bytes), "postings")
    mean = rows.groupBy("document_id").agg(F.sum("of").alias("of"), (F.sum("total") / F.sum("of")).alias("mean"))
    df = rows.select("document_id", F.explode(F.array_distinct(F.transform("p", lambda x: x["term"]))).alias("term")).groupBy("document_id", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("of") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = store.written(df.join(mean, "document_id").select("document_id", "term", idf.alias("idf"), "mean"), "weights")
    spark = chunks.sparkSession
    size = wanted.agg(F.sum(16 + F.length(F.array_join("t", " ")) + 8 * F.size("t")).alias("n")).first()["n"]
    passes = -(-(size or 0) // broadcast_bytes)

    def held(number: int):
        own = wanted.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == number)
        known: dict = {}
        for x in weights.join(own.select("document_id", F.explode("t").alias("term")).distinct(), ["document_id", "term"]).toArrow().to_pylist():
            known.setdefault(x["document_id"], {})[x["term"]] = x["idf"], x["mean"]
        by = {}
        for document, q in own.toPandas().groupby("document_id"):
            at = {t: i for i, t in enumerate(sorted({t for ts in q["t"] for t in ts}))}
            places = np.full((len(q), max(map(len, q["t"]))), len(at), np.int32)  # the last row of weights is 0 for every chunk
            for i, ts in enumerate(q["t"]):
                places[i, : len(ts)] = [at[t] for t in ts]
            idf, mean = (np.array([known.get(document, {}).get(t, (0.0, 1.0))[j] for t in at]) for j in range(2))
            by[document] = q["qid"].to_numpy(), pa.array(list(at), pa.string()), places, idf, mean
        return spark.sparkContext.broadcast(by)

    def best_of(by):
        def run(batches):
            best = Best(k)
            for batch in batches:
                for document in batch.column("document_id").unique().to_pylist():
                    if document not in by.value:
                        continue
                    qids, at, places, idf, mean = by.value[document]
                    some = batch.filter(pc.equal(batch.column("document_id"), document))
                    for first in range(0, some.num_rows, block):
                        own = some.slice(first, block)
                        postings = own.column("p").flatten()
                        code = pc.fill_null(pc.index_in(pc.struct_field(postings, 0), value_set=at), -1).to_numpy(zero_copy_only=False)
                        column = np.repeat(np.arange(own.num_rows), pc.list_value_length(own.column("p")).to_numpy(zero_copy_only=False))[code >= 0]
                        tf = np.zeros((len(at), own.num_rows))
                        np.add.at(tf, (code[code >= 0], column), pc.struct_field(postings, 1).to_numpy(zero_copy_only=False)[code >= 0])
                        weights = np.full((len(at) + 1, own.num_rows), -np.inf)
                        weights[-1] = 0.0
                        i, j = np.nonzero(tf)
                        n = own.column("n").to_numpy(zero_copy_only=False)
                        weights[i, j] = idf[i] * tf[i, j] * (K1 + 1) / (tf[i, j] + K1 * (1 - B + B * n[j] / mean[i]))
                        held_by = (weights > -np.inf).any(axis=1)
                        there = np.flatnonzero(held_by[places].all(axis=1))  # queries whose terms all occur in these chunks
                        ids = own.column("id").to_numpy(zero_copy_only=False).astype(str)
                        for low in range(0, len(there), block):
                            q = there[low : low + block]
                            score = weights[places[q, 0]]
                            for j in range(1, places.shape[1]):
                                score = score + weights[places[q, j]]
                            best.add(qids[q], ids, score)
            for f in best.frames():
                yield pa.RecordBatch.from_pandas(f.astype({"id": object}), preserve_index=False)

        return run

    found = [spark.createDataFrame([], "qid long, id string, score double")]
    for number in range(passes):
        by = held(number)
        one = _dealt(rows).mapInArrow(best_of(by), "qid long, id string, score double")
        if passes > 1:
            one = store.written(one, "found")  # so that no two passes hold their queries at once
            by.destroy()
        found.append(one)
    return _first(reduce(DataFrame.unionByName, found), k, F.desc("score"), "id").select("qid", "id", "rank")


def semantic_lanes(chunks: DataFrame, queries: DataFrame, k: int, column: str = "search_embedding", block: int = 512, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """qid, id, rank of the k chunks of its document nearest to each query, exactly."""
    spark = chunks.sparkSession
    asked = queries.where("embedding is not null").select("document_id", "qid", "embedding")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    passes = max(1, -(-size["n"] * 8 * max(1, size["d"] or 1) // broadcast_bytes))
    rows = chunks.where(F.col(column).isNotNull()).select("document_id", F.col("id").cast("string").alias("id"), F.col(column).alias("v"))

    def held(number: int):
        own = asked.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == number).toPandas()
        by = {}
        for document, part in own.groupby("document_id"):
            m = np.array(part["embedding"].tolist(), np.float64)
            norm = np.linalg.norm(m, axis=1)
            by[document] = part["qid"].to_numpy()[norm > 0], m[norm > 0] / norm[norm > 0][:, None]
        return spark.sparkContext.broadcast(by)

    def nearest(by):
        def run(frames):
            best = Best(k)
            for frame in frames:
                for document, part in frame.groupby("document_id", sort=False):
                    qids, q = by.value.get(document, ((), None))
                    m = np.array(part["v"].tolist(), np.float64)
                    norm = np.linalg.norm(m, axis=1)
                    ids, m = part["id"].to_numpy(dtype=str)[norm > 0], m[norm > 0] / norm[norm > 0][:, None]
                    for low in range(0, len(qids) if len(ids) else 0, block):
                        best.add(qids[low : low + block], ids, q[low : low + block] @ m.T)
            yield from (f.astype({"id": object}) for f in best.frames())

        return run

    found = []
    for number in range(passes):
        by = held(number)
        one = _dealt(rows).mapInPandas(nearest(by), "qid long, id string, score double")
        if passes > 1:
            one = store.written(one, "nearest")  # so that no two passes hold their vectors at once
            by.destroy()
        found.append(one)
    return _first(reduce(DataFrame.unionByName, found), k, F.desc("score"), "id").select("qid", "id", "rank")


def hybrid_batch(chunks: DataFrame, queries: DataFrame, top_k: int = 10, rrf_k: int = 60) -> DataFrame:
    """qid, rank (from 1), id, rrf, parent_id of the fused list of each query. Comprehensive ones have all parents of their document in page order, without rrf."""
    asked = queries.where("qid is not null and document_id is not null")
    asked = store.written(asked.withColumn("kind", F.coalesce("kind", query_type(F.col("query")))).withColumn("qid", F.col("qid").cast("long")), "asked")
    ranked = asked.where("kind <> 'comprehensive'")
    lanes = [("section", section_lanes(chunks, ranked, top_k)), ("semantic", semantic_lanes(chunks, ranked, top_k)), ("keyword", keyword_lanes(chunks, ranked, top_k))]
    lanes += [(kind, semantic_lanes(chunks, ranked.where(F.col("kind") == kind), top_k, f"{kind}_embedding")) for kind in ("formula", "table")]
    lane = lambda name, rows: rows.select("qid", F.col("id").cast("string").alias("id"), F.lit(LANES.index(name)).alias("lane_ord"), "rank")
    fused = reciprocal_rank_fusion(reduce(DataFrame.unionByName, [lane(*x) for x in lanes]), rrf_k, ("qid",))
    fused = store.written(fused, "fused")  # top_k rows of each lane and query, read three times below
    # of its chunks a search needs who is whose parent
    tree = chunks.select(F.col("id").cast("string").alias("id"), "is_parent", F.col("parent_id").cast("string").alias("parent_id"))
    known = fused.join(tree, "id", "left")
    covered = known.where("parent_id is not null").select("qid", F.col("parent_id").alias("id")).distinct().withColumn("covered", F.lit(True))
    kept = known.join(covered, ["qid", "id"], "left").where(~(F.coalesce("is_parent", F.lit(False)) & F.coalesce("covered", F.lit(False))))
    kept = _first(kept, top_k, F.desc("rrf"), "first_seen", "id").select("qid", (F.col("rank") + 1).alias("rank"), "id", "rrf", "parent_id")
    # the parents of a document are numbered once, for all its queries; a qid that several have is numbered over the parents of all of them
    asks = asked.where("kind = 'comprehensive'").select("qid", "document_id").withColumn("alone", F.count("*").over(Window.partitionBy("qid")) == 1)
    order = [F.asc_nulls_last("page_start"), F.asc_nulls_last("page_end"), F.col("id")]
    parents = chunks.where(F.coalesce("is_parent", F.lit(True))).select("document_id", F.col("id").cast("string").alias("id"), "page_start", "page_end")
    numbered = store.written(parents.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(*order))), "parents")
    numbered = numbered.repartition(max(12, 3 * chunks.sparkSession.sparkContext.defaultParallelism))  # a document's parents are many rows below
    shared = numbered.drop("rank").join(asks.where("not alone"), "document_id").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    whole = numbered.join(asks.where("alone"), "document_id").select("qid", "rank", "id").unionByName(shared.select("qid", "rank", "id"))
    return kept.unionByName(whole.select("qid", "rank", "id", F.lit(None).cast("double").alias("rrf"), F.lit(None).cast("string").alias("parent_id")))
