"""Substring dedup by level-wise doubling.

Windows of a quarter of the target length are tried first; only where they repeat are
windows of twice that length tried, and so on up to the target. At each shorter level a
target window is stood for by one anchor, the shorter window in it with the least hash
(the leftmost of ties). Equal target windows have equal anchors in the same place, so a
target window whose anchor occurs once is unique and drops out; anchors are a small share
of all positions. At the last level the target windows of each repeated anchor are
compared with each other by a 128-bit digest of their words (blake2b), not by the hashes
that chose the anchors; so no construction of words makes different windows equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_lists, prepare, small, stage, table
from .hashes import run_hashes

WINDOW = 35
#: The first level is the first halving of the target at most this long.
FIRST = 10
#: Occurrences of an anchor that one group holds; more are dealt to several.
GROUP_ROWS = 20_000


def levels(window: int) -> list[int]:
    out = [window]
    while out[0] > FIRST:
        out.insert(0, -(-out[0] // 2))
    return out


def anchors(hashes: np.ndarray, level: int, window: int) -> np.ndarray:
    """For each target window, the place of its anchor among the hashes of the level's windows."""
    inside = np.lib.stride_tricks.sliding_window_view(hashes, window - level + 1)
    return inside.argmin(axis=1) + np.arange(len(inside))


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*values, np.empty(0, kind)]).astype(kind)))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def window_digests(words: list[bytes], starts: np.ndarray, window: int) -> bytes:
    """16 bytes for each window of the words from starts: a digest of what it says."""
    raw = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(begins[starts].tolist(), ends[starts + window - 1].tolist(), strict=True)
    return b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in spans])


def repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all, repeats): all has id, h, n_words, sha for each row of docs; repeats has id, h and the starts of its repeated windows.

    h is the text's hash: rows are told apart by id and text, and a row that comes twice
    repeats itself.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    lengths = levels(window)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text")).select("id", "h", "text")

    def first(batches):
        for batch in batches:
            words = [t.split() if t else [] for t in batch.column(2).cast(pa.binary()).to_pylist()]
            hashes, spots = [], []
            for w in words:
                if len(w) < window:
                    hashes.append(np.empty(0, np.int64))
                    spots.append(np.empty(0, np.int32))
                    continue
                found = run_hashes(w, lengths[0])[0]
                at = np.unique(anchors(found, lengths[0], window))
                hashes.append(found[at].view(np.int64))
                spots.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array([_digest(w) for w in words]), _lists(hashes, np.int64), _lists(spots, np.int32)],
                names=["id", "h", "n_words", "sha", "anchors", "spots"],
            )

    whole = stage(own.mapInArrow(first, f"id {kind}, h long, n_words long, sha string, anchors array<long>, spots array<int>"), "repeat-first")
    alive = _repeated(whole)

    def among(places: np.ndarray, spots: list[int]) -> np.ndarray:
        """The starts of target windows whose anchor is at one of the spots."""
        held = np.zeros(int(places.max()) + 1, dtype=bool)
        held[spots] = True
        return np.flatnonzero(held[places])

    for before, level in zip(lengths[:-2], lengths[1:-1], strict=False):

        def longer(batches, before=before, level=level):
            for batch in batches:
                hashes, places = [], []
                for text, spots in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    shorter, found = run_hashes(text.split(), before, level)
                    starts = among(anchors(shorter, before, window), spots)
                    at = np.unique(anchors(found, level, window)[starts])
                    hashes.append(found[at].view(np.int64))
                    places.append(at)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(hashes, np.int64), _lists(places, np.int32)], names=["id", "h", "anchors", "spots"])

        texts = join_lists(own, alive)
        alive = _repeated(stage(texts.mapInArrow(longer, f"id {kind}, h long, anchors array<long>, spots array<int>"), "repeat-longer"))

    level = lengths[max(0, len(lengths) - 2)]

    def last(batches):
        """A row for each anchor and unbroken run of its candidate windows: their digests, packed."""
        for batch in batches:
            ids, prints, marks, firsts, packed = [], [], [], [], []
            for n, (text, spots) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = text.split()
                found = run_hashes(words, level)[0]
                at = anchors(found, level, window)
                starts = among(at, spots)
                if not len(starts):
                    continue
                raw = window_digests(words, starts, window)
                cuts = np.flatnonzero((np.diff(starts) > 1) | (np.diff(at[starts]) != 0)) + 1
                edges = [0, *cuts.tolist(), len(starts)]
                ids += [n] * (len(edges) - 1)
                marks.append(found[at[starts[edges[:-1]]]].view(np.int64))
                firsts.append(starts[edges[:-1]])
                packed += [raw[16 * a : 16 * b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            take = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate([*marks, np.empty(0, np.int64)])), pa.array(np.concatenate([*firsts, np.empty(0, np.int64)]).astype(np.int32)), pa.array(packed, pa.binary())],
                names=["id", "h", "anchor", "start", "windows"],
            )

    texts = join_lists(own, alive)
    rows = stage(texts.mapInArrow(last, f"id {kind}, h long, anchor long, start int, windows binary"), "repeat-last")

    hot = rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS)
    hot = small(stage(hot.select("anchor", F.ceil(F.col("n") / GROUP_ROWS).alias("deals")), "repeat-hot"))
    dealt = rows.join(hot, "anchor", "left").withColumn("deal", F.when(F.col("deals") > 1, F.pmod(F.xxhash64("id", "h", "start"), "deals")).otherwise(-1))
    dealt = dealt.select("id", "h", "anchor", "deal", "start", "windows").repartition("anchor", "deal").sortWithinPartitions("anchor", "deal")

    def judged(batches):
        """starts of the windows that repeat in their group; of a dealt group also each distinct window, placed if it came once."""

        def judge(parts):
            group = pa.Table.from_batches(parts).combine_chunks()
            raw = group.column("windows").combine_chunks()
            offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1] // 16
            flat = np.frombuffer(raw.buffers()[2], np.uint64, int(offsets[-1]) * 2).reshape(-1, 2)[offsets[0] : offsets[-1]]
            flat, more = flat[:, 0], flat[:, 1]
            counts = np.diff(offsets)
            row = np.repeat(np.arange(len(counts)), counts)
            at = np.asarray(group.column("start"))[row] + np.arange(len(flat)) - (offsets[:-1] - offsets[0])[row]
            anchor = np.asarray(group.column("anchor"))[row]
            deal = np.asarray(group.column("deal"))[row]
            order = np.lexsort((more, flat, deal, anchor))
            a, d, w, v = anchor[order], deal[order], flat[order], more[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (w[1:] != w[:-1]) | (v[1:] != v[:-1])])
            number = np.cumsum(new) - 1
            times = np.bincount(number)
            again = np.empty(len(flat), dtype=bool)
            again[order] = times[number] > 1
            kept = np.unique(row[again])
            inside = np.split(at[again], np.flatnonzero(np.diff(row[again])) + 1) if again.any() else []
            take = pa.array(kept)
            out = [group.column("id").take(take), group.column("h").take(take), pa.chunked_array([_lists(inside, np.int32)]), *[pa.nulls(len(kept), pa.int64())] * 3]
            yield pa.table(out, names=["id", "h", "starts", "anchor", "window", "more"])
            each = order[new & (d >= 0)]
            if len(each):
                once = ~again[each]
                ids = pa.array(np.where(once, row[each], -1), mask=~once)
                places = _lists([at[k : k + 1] if ok else np.empty(0, np.int32) for k, ok in zip(each, once, strict=True)], np.int32)
                yield pa.table([group.column("id").take(ids), group.column("h").take(ids), pa.chunked_array([places]), pa.array(anchor[each]), pa.array(flat[each].astype(np.int64)), pa.array(more[each].astype(np.int64))], names=["id", "h", "starts", "anchor", "window", "more"])

        waiting = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(2)), np.asarray(batch.column(3))])
            breaks = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1
            fresh = waiting and (waiting[-1].column(2)[-1].as_py(), waiting[-1].column(3)[-1].as_py()) != tuple(keys[:, 0].tolist())
            if fresh:
                for t in judge(waiting):
                    yield from t.to_batches()
                waiting = []
            if len(breaks):  # all but the last group are whole
                for t in judge([*waiting, batch.slice(0, int(breaks[-1]))]):
                    yield from t.to_batches()
                waiting = []
                batch = batch.slice(int(breaks[-1]))
            waiting.append(batch)
        if waiting:
            for t in judge(waiting):
                yield from t.to_batches()

    seen = stage(dealt.mapInArrow(judged, f"id {kind}, h long, starts array<int>, anchor long, window long, more long"), "repeat-judged")
    spread = seen.where("window IS NOT NULL")
    twice = stage(spread.groupBy("anchor", "window", "more").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeat-spread")
    late = spread.where("size(starts) > 0").join(twice, ["anchor", "window", "more"]).select("id", "h", "starts")
    found = seen.where("window IS NULL").select("id", "h", "starts").unionAll(late)
    found = found.groupBy("id", "h").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return whole.select("id", "h", "n_words", "sha"), stage(found, "repeat-found")


def _repeated(rows: DataFrame) -> DataFrame:
    """id, h and the spots of rows' anchors that occur twice or more."""
    each = rows.select("id", "h", "spots", F.posexplode("anchors").alias("k", "anchor")).select("id", "h", "anchor", F.expr("get(spots, k)").alias("spot"))
    # written first: Spark splits a hot anchor's rows over tasks only in a join of two plain exchanges
    twice = stage(each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeat-twice")
    return stage(each.join(twice, "anchor").groupBy("id", "h").agg(F.collect_set("spot").alias("spots")), "repeat-alive")


def drop_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept_sha256, and the kept text if with_text.

    Words lie between ASCII white space and are compared as they are. A word goes if it is
    in a window of that many words which also starts anywhere else, in the same text or
    another, all windows being judged on the input. The kept words are joined by one
    space. Null or empty text has no words; a text of fewer words than a window keeps all.
    Repeated rows count as separate documents. Texts are read whole; a null id is an id. An
    empty table gives no rows; other columns are ignored.
    """
    whole, repeats = repeated_windows(docs, window, id_col, text_col)
    kind = dict(docs.dtypes)[id_col]

    def keep(batches):
        for batch in batches:
            kept, counts = [], []
            for text, starts in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                if starts:
                    at = np.unique(starts)
                    edge[at] += 1
                    np.subtract.at(edge, at + window, 1)
                gone = np.cumsum(edge)[:-1] > 0
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
                counts.append((len(words), int(gone.sum())))
            out = [batch.column(0), pa.array([n for n, _ in counts], pa.int64()), pa.array([k for _, k in counts], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out, names = [*out, pa.array([k.decode("utf-8", "replace") for k in kept])], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("h", F.xxhash64("text")).select("id", "h", "text")
    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        same = own["id"].eqNullSafe(repeats["id"]) & (own["h"] == repeats["h"])
        texts = own.join(repeats, same, "left").select(own["id"], "text", "starts")
        return texts.mapInArrow(keep, schema + ", kept_text string").withColumnRenamed("id", id_col)
    cut = join_lists(own, repeats).select("id", "text", "starts").mapInArrow(keep, schema)
    found = small(repeats.select(F.col("id").alias("i"), F.col("h").alias("g")))
    rest = whole.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left_anti")
    rest = rest.select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return cut.unionAll(rest).withColumnRenamed("id", id_col)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated windows of 35 words: n_words, n_removed, kept_sha256."""
    return drop_repeats(table(spark, sf_dir, "documents"))


OP3_SQL = rf"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM t WHERE len(w) >= {WINDOW})
), twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1
), starts AS (SELECT doc_id, list(i) AS s FROM win SEMI JOIN twice USING (h) GROUP BY doc_id
), gone AS (
  SELECT doc_id, list_distinct(flatten(list_transform(s, lambda x: range(x, x + {WINDOW})))) AS p FROM starts
), kept AS (
  SELECT t.doc_id, len(w) AS n, coalesce(len(p), 0) AS k,
         list_filter(w, lambda x, i: p IS NULL OR NOT list_contains(p, i)) AS words FROM t LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_words, k::BIGINT AS n_removed, sha256(coalesce(array_to_string(words, ' '), '')) AS kept_sha256 FROM kept
"""
