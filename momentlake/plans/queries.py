"""The registered queries of the search, evaluation and maintenance operators."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentlake.functions import text, vectors
from momentlake.functions.keys import compared, epoch_of
from momentlake.operators import boxes, gate, metrics, ranking
from momentlake.plans import report
from momentlake.plans.engine import Engine
from momentlake.session import shared_folder
from momentlake.sources import audit, store, tables

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _vector(spark: SparkSession, d: str, vec_id: int = 17) -> list[float]:
    return _t(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _moments(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as an item table: three items to a time stamp, one a frame."""
    v = F.col("vec_id")
    return _t(spark, d, "embeddings").select(
        v.alias("id"), F.col("label").cast("string").alias("video_id"), (F.floor(v / 3) * 0.5).alias("t"), F.floor(v / 3).cast("int").alias("frame_idx"),
        F.when(v % 3 == 0, "frame").otherwise("crop").alias("kind"), F.when(v % 3 != 0, boxes.label_of(v % 8)).alias("label"), F.col("embedding").alias("emb"),
    )


def _scored(spark: SparkSession, d: str, metric: str = "dot") -> DataFrame:
    s = vectors.score(_moments(spark, d).select(F.col("id").alias("item_id"), "video_id", "t", "kind", "emb"), "emb", np.array(_vector(spark, d)), metric=metric)
    return s.withColumn("score", F.col("score")[0])


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("video_id"), epoch_of("ts").alias("t"), "event_type", "value")


def _event_hits(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as the ranked hits of a query on a video named after the user."""
    e = _events(spark, d).select(F.col("video_id").alias("query_id"), F.col("video_id").alias("video_name"), "t", "value", "event_id", "event_type")
    return ranking.numbered(e, [F.desc("value"), F.asc("event_id")], ["query_id"])


def _event_truth(spark: SparkSession, d: str) -> DataFrame:
    """For each user six hours of truth, beginning some days after the first event."""
    first = _events(spark, d).groupBy("video_id").agg(F.min("t").alias("first"))
    start = F.col("first") + F.col("video_id").cast("long") % 25 * 86400
    return first.select(F.col("video_id").alias("query_id"), F.col("video_id").alias("video_name"), start.alias("start"), (start + 21600).alias("end"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(F.col("video_id").alias("query_id")).distinct().withColumn("category", F.when(F.col("query_id").cast("long") % 4 == 0, "scene").otherwise("event"))


# --- vectors and ranking


@query
def cosine_topk(spark, d):
    return ranking.top_k(_scored(spark, d), 10).select("item_id", "score")


@query
def cosine_true_metric(spark, d):
    return ranking.top_k(_scored(spark, d, "cosine"), 10).select("item_id", "score")


@query
def cosine_expression(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding", F.array(*map(F.lit, _vector(spark, d))).alias("q"))
    return e.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q"), 1e-12), 6).alias("cosine"))


@query
def normalised_vectors(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x * 3).alias("v"))
    return e.select("vec_id", F.round(vectors.norm(vectors.normalise(F.col("v"))), 6).alias("length"), F.round(vectors.normalise(F.col("v"))[0], 6).alias("first"))


@query
def multi_query_batch(spark, d):
    q = _t(spark, d, "embeddings").where("vec_id in (3, 17, 42, 101, 250)").orderBy("vec_id").select("embedding").collect()  # five query vectors
    s = vectors.score(_t(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", np.array([r[0] for r in q]))
    rows = s.select("vec_id", F.posexplode("score").alias("query", "score"))
    return ranking.numbered(rows, [F.desc("score"), F.asc("vec_id")], ["query"], "place").where("place <= 10")


@query
def multi_query_batch_all(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.batch_top_k(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, dim=64)


@query
def embedding_fidelity(spark, d):
    e = _t(spark, d, "embeddings")
    a, b = e.select("vec_id", F.col("embedding").alias("a"), "label"), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").groupBy("label").agg(F.round(F.avg(F.round(vectors.cosine(F.col("a"), F.col("b")), 6)), 4).alias("mean_cosine"), F.count("*").alias("n"))


@query
def best_per_timestamp(spark, d):
    return ranking.best_per_timestamp(_scored(spark, d))


@query
def merge_hits(spark, d):
    ranked = _events(spark, d).select("video_id", "t", F.col("event_id").alias("item_id"), F.col("value").alias("score"))
    return ranking.merge_hits(ranked, 43200.0)


@query
def search_pipeline(spark, d):
    return Engine(_moments(spark, d)).search(_vector(spark, d), top_k=10)


@query
def frames_only_search(spark, d):
    return Engine(_moments(spark, d)).search(_vector(spark, d), top_k=10, use_crops=False)


@query
def video_filter_search(spark, d):
    return Engine(_moments(spark, d)).search(_vector(spark, d), top_k=10, video_ids=["1", "4", "7"])


def _item_engine(spark: SparkSession, d: str) -> Engine:
    """The items that name a video; vectors are as delivered, so they are scored by the true cosine. Repeated rows score alike and count once."""
    items = _t(spark, d, "items").select("id", compared("video_id").alias("video_id"), "t", "kind", "frame_idx", "emb")
    return Engine(items, config={"index": {"metric": "cosine"}})


def _item_vectors(spark: SparkSession, d: str, n: int) -> np.ndarray:
    """The vectors of the first ``n`` items with a usable one, by id (the search's questions)."""
    items, found, last = _t(spark, d, "items").select("id", "emb"), {}, -1
    while len(found) < n:
        rows = items.where(F.col("id") > last).orderBy("id").limit(4 * n).collect()
        for r in rows:
            v = np.array(r.emb if r.emb is not None and None not in r.emb else [], np.float64)
            if len(v) == 512 and np.isfinite(v).all() and v.any() and len(found) < n:
                found.setdefault(r.id, v)
        if len(rows) < 4 * n:
            break
        last = rows[-1].id
    return np.array([found[i] for i in sorted(found)]).reshape(-1, 512)


@query
def item_search(spark, d):
    """Search over all items with the vector of the first one."""
    q = _item_vectors(spark, d, 1)
    hits = _item_engine(spark, d).search(q[0].tolist() if len(q) else [1.0] * 512, top_k=10)
    return hits.select("item_id", "video_id", "t", "score", "t_start", "t_end", "merged", "kind", "frame_idx")


@query
def item_search_batch(spark, d):
    """Sixteen searches over all items in one job."""
    q = _item_vectors(spark, d, 16)
    hits = _item_engine(spark, d).search_many(q if len(q) else np.ones((1, 512)), top_k=10)
    return hits.select("query", "rank", "item_id", "video_id", "t", "score", "t_start", "t_end", "merged")


@query
def rerank_blend(spark, d):
    hits = ranking.merge_hits(ranking.best_per_timestamp(_scored(spark, d)), 3.0, 50)
    ranked = ranking.numbered(hits, [F.desc("score"), F.asc("item_id")])
    p = F.when(F.col("item_id") % 3 == 0, F.lit(None)).otherwise((F.col("item_id") % 10) / 10)
    return ranking.rerank(ranked.withColumn("p_yes", p), 0.7).select("item_id", "rank", F.round("final_score", 6).alias("final_score"))


@query
def hits_with_names(spark, d):
    videos = _t(spark, d, "videos").select(compared("id").alias("id"), "name").groupBy("id").agg(F.min("name").alias("name"))
    hits = _t(spark, d, "hits").select("hit_id", compared("video_id").alias("video_id")).where("video_id is not null").distinct()
    return ranking.name_videos(hits, videos, "?").groupBy("video_name").agg(F.count("*").alias("n"))


@query
def enriched_hits(spark, d):
    items = _t(spark, d, "items").select("id", "label", "frame_idx", "thumb").distinct()
    hits = _t(spark, d, "hits").select("hit_id", "item_id", "score").distinct()
    return ranking.enrich(hits, items).groupBy(F.coalesce("label", F.lit("-")).alias("label")).agg(F.count("*").alias("n"), F.countDistinct("thumb").alias("thumbs"))


# --- sampling and gate


@query
def frame_sampling(spark, d):
    frames = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("video"), F.col("l_linenumber").alias("frame_idx"), (F.col("l_orderkey") % 31).cast("double").alias("fps"))
    return gate.sample_frames(frames, F.col("fps"), 7.0).groupBy("frame_idx").agg(F.count("*").alias("n"), F.round(F.sum("t"), 6).alias("t_sum"))


def _gated(spark, d):
    frames = _events(spark, d).select("video_id", "t", F.col("value").alias("signal"), F.col("event_id").alias("frame_idx"))
    return gate.motion_gate(frames, "video_id", "t", "signal", "frame_idx", method="score", min_fraction=400.0, heartbeat=86400.0)


@query
def motion_gate_heartbeat(spark, d):
    return _gated(spark, d).select("video_id", "frame_idx", "kept", "by_heartbeat")


@query
def gate_stats(spark, d):
    return gate.gate_stats(_gated(spark, d), ["video_id"])


def _cells(spark, d):
    return _moments(spark, d).select("video_id", "t", F.transform("emb", lambda x: x.cast("double")).alias("signal"), F.col("id").alias("frame_idx"))


@query
def motion_gate_diff(spark, d):
    g = gate.motion_gate(_cells(spark, d), "video_id", "t", "signal", "frame_idx", method="diff", min_fraction=0.5, heartbeat=20.0, diff_threshold=0.15)
    return g.select("video_id", "frame_idx", F.round("score", 6).alias("score"), "kept")


@query
def motion_gate_background(spark, d):
    g = gate.motion_gate(_cells(spark, d), "video_id", "t", "signal", "frame_idx", method="background", min_fraction=0.02, heartbeat=20.0, diff_threshold=0.5)
    return gate.gate_stats(g, ["video_id"])


@query
def step_sampling(spark, d):
    e = _t(spark, d, "events").select("event_id", "event_type")
    n = e.count()
    low = e.agg(F.min("event_id")).first()[0]
    return gate.step_sample(e.withColumn("pos", F.col("event_id") - F.lit(low)), "pos", 100, n).select("event_id", "event_type")


@query
def seeded_sampling(spark, d):
    return gate.seeded_sample(_t(spark, d, "events").select("event_id", "event_type"), "event_id", 50, 7)


# --- metrics


@query
def first_correct_rank(spark, d):
    return _first_ranks(spark, d).withColumn("first_rank", F.col("first_rank").cast("double"))


def _first_ranks(spark, d):
    return metrics.first_correct_rank(_queries(spark, d), _event_hits(spark, d), _event_truth(spark, d), 0.25)


@query
def recall_mrr_rollup(spark, d):
    return metrics.summary_by(_first_ranks(spark, d), "category")


@query
def gt_coverage(spark, d):
    stamps = _events(spark, d).select(F.col("video_id").alias("video_name"), "t")
    c = metrics.coverage(_queries(spark, d), stamps, _event_truth(spark, d), 0.25)
    return c.agg(F.round(F.avg("coverage"), 6).alias("mean_coverage"), F.round(F.max("coverage"), 6).alias("most"), F.count("*").alias("n"))


@query
def truth_stamps(spark, d):
    stamps = _events(spark, d).select("event_id", F.col("video_id").alias("video_name"), "t")
    return metrics.in_truth(stamps, _event_truth(spark, d).drop("query_id"), 0.25).select("event_id")


@query
def distinct_stamps(spark, d):
    return _scored(spark, d).select("video_id", F.round("t", 3).alias("t")).distinct()


@query
def latency_p95(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(*metrics.latency("value"))


@query
def index_cost_rollup(spark, d):
    e = _t(spark, d, "events")
    runs = e.select("event_type", F.concat(F.lit("v"), (F.col("user_id") % 7).cast("string")).alias("name"), (F.col("value") / 10).alias("wall_s"), (F.col("event_id") % 50).alias("seen"), (F.col("event_id") % 20).alias("kept"), (F.col("event_id") % 12).alias("crops"), F.col("value").alias("duration_s"))
    return metrics.index_cost(runs, "event_type", "name")


@query
def provider_counts(spark, d):
    e = _t(spark, d, "events")
    events = e.select(F.when(F.col("event_id") % 5 == 0, "Session").otherwise("Node").alias("cat"), F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "_fence").otherwise("_kernel_time")).alias("name"), F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("P"), (F.col("user_id") % 4).cast("string"))).alias("provider"))
    return metrics.counts_by(metrics.kernel_events(events), F.col("provider"), "provider", "unknown")


@query
def config_compare(spark, d):
    h = _event_hits(spark, d).groupBy("query_id", "event_type").agg(F.min("rank").cast("double").alias("first_rank"))
    return metrics.compare_configs(h, "event_type", "click", "purchase")


@query
def truth_remap(spark, d):
    truth = tables.explode_truth(_t(spark, d, "eval_queries"))
    mapping = truth.select("video_name").distinct().where(F.col("video_name").endswith("1.avi")).select("video_name", F.concat(F.lit("long_"), "video_name").alias("new_name"), F.lit(10.5).alias("offset"))
    return metrics.remap_truth(truth.select("query_id", "video_name", "start", "end"), mapping)


# --- text and scalars


@query
def text_clean(spark, d):
    return _t(spark, d, "audit_log").select("seq", "query").distinct().select("seq", text.clean_plain(F.col("query")).alias("cleaned"))


@query
def text_clean_entities(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query
def pretokenize(spark, d):
    return _t(spark, d, "audit_log").select("query").where("query is not null").distinct().select("query", F.array_join(text.pieces(text.clean_plain(F.col("query"))), "|").alias("pieces"))


@query
def token_rows(spark, d):
    return text.token_rows(_t(spark, d, "audit_log").select("seq", "query").distinct(), "seq", "query").groupBy("piece").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


@query
def token_pad(spark, d):
    ids = F.transform(text.pieces(text.clean_plain(F.col("query"))), lambda p: F.length(p))
    return _t(spark, d, "eval_queries").select("id", F.array_join(text.fit_tokens(ids, 49406, 49407, 12), ",").alias("tokens"))


@query
def token_pad_full(spark, d):
    ids = F.transform(text.pieces(text.clean_plain(F.col("query"))), lambda p: F.length(p))
    return _t(spark, d, "eval_queries").select("id", F.array_join(text.fit_tokens(ids, 49406, 49407), ",").alias("tokens"))


@query
def bpe_tokens(spark, d):
    encode = text.bpe_encoder(os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "word_bpe_49k.json"))
    return _t(spark, d, "eval_queries").select("id", text.fit_tokens(encode(text.clean(F.col("query"))), 49406, 49407).alias("tokens"))


@query
def parse_yes_no(spark, d):
    e = _t(spark, d, "events")
    k = F.col("event_id") % 6
    answer = F.when(k == 0, " **Yes** it is").when(k == 1, "No, nothing").when(k == 2, "Maybe").when(k == 3, "").when(k == 4, "\"yes.\"").otherwise(F.concat(F.lit("no"), "event_type"))
    return e.select("event_id", text.yes_no(answer).alias("answer"))


@query
def p_yes_logprobs(spark, d):
    e = _t(spark, d, "events")
    tokens = F.format_string('{"logprobs":{"content":[{"top_logprobs":[{"token":" Yes","logprob":%.4f},{"token":"%s","logprob":%.4f}]}]}}', -F.col("value") / 100, F.when(F.col("event_id") % 3 == 0, "no").otherwise("perhaps"), F.lit(-1.5))
    return e.select("event_id", F.round(text.p_yes(F.when(F.col("event_id") % 7 == 0, "{}").otherwise(tokens)), 6).alias("p_yes"))


@query
def timecode_format(spark, d):
    return _t(spark, d, "items").where("t is not null").select("t").distinct().select("t", text.timecode(F.col("t")).alias("code"), text.playback_start(F.col("t")).alias("start"))


@query
def slugs(spark, d):
    return _t(spark, d, "videos").select("name").distinct().select("name", text.slug(F.col("name")).alias("slug"), text.precision_label(F.col("name")).alias("precision"))


@query
def report_numbers(spark, d):
    return _t(spark, d, "events").select("event_id", text.report_number(F.when(F.col("event_id") % 9 != 0, F.col("value") / 100)).alias("shown"))


@query
def content_ids(spark, d):
    docs = _t(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", tables.video_id(F.col("source"), F.octet_length("text"), F.col("text").cast("binary")).alias("video_id"))


@query
def hit_captions(spark, d):
    items = _t(spark, d, "items").where("t is not null and conf is not null").select("id", "video_id", "t", "kind", "label", "conf").distinct()
    return items.select("id", text.hit_caption(F.col("label"), F.col("kind"), F.col("conf"), F.col("t"), compared("video_id")).alias("caption"))


@query
def hit_captions_all(spark, d):
    """Captions of frames and crops alike; a frame has no confidence and is shown with 1."""
    items = _t(spark, d, "items").where("t is not null").select("id", "video_id", "t", "kind", "label", F.coalesce("conf", F.lit(1.0)).alias("conf")).distinct()
    return items.select("id", text.hit_caption(F.col("label"), F.col("kind"), F.col("conf"), F.col("t"), compared("video_id")).alias("caption"))


# --- boxes


def _boxes(spark, d, shift: int = 0) -> DataFrame:
    line = _t(spark, d, "lineitem")
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    x, y = (p * 7 + n * 13) % 60 + shift, (s * 11 + n * 5) % 60
    return line.select(
        F.col("l_orderkey").alias("frame"), n.alias("pos"), (p % 2).cast("int").alias("cls"), F.round(F.col("l_extendedprice") / 200000 + F.lit(0.001) * n, 4).alias("conf"),
        x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 60 + s % 20).cast("double").alias("x2"), (y + 50 + p % 30).cast("double").alias("y2"),
    )


@query
def class_nms(spark, d):
    return boxes.suppress(_boxes(spark, d), ["frame"], 0.5).select("frame", "cls", "pos")


@query
def clipped_boxes(spark, d):
    return boxes.clip(_boxes(spark, d), F.lit(100), F.lit(90), 20).select("frame", "pos", "x1", "y1", "x2", "y2")


@query
def detection_agreement(spark, d):
    return boxes.agreement(_boxes(spark, d), _boxes(spark, d, 9).where("pos % 4 <> 0"), ["frame"])


@query
def detection_agreement_whole(spark, d):
    return boxes.agreement(_boxes(spark, d), _boxes(spark, d, 9), ["frame"])


@query
def box_iou(spark, d):
    a, b = _boxes(spark, d), _boxes(spark, d, 9)
    box = F.struct("x1", "y1", "x2", "y2")
    pairs = a.select("frame", "pos", box.alias("a")).join(b.select("frame", (F.col("pos") - 1).alias("pos"), box.alias("b")), ["frame", "pos"])
    return pairs.select("frame", "pos", F.round(boxes.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query
def top_n_per_frame(spark, d):
    return boxes_top(_boxes(spark, d))


def boxes_top(b: DataFrame) -> DataFrame:
    return ranking.top_n_per_frame(b, 3, ["frame"]).select("frame", "pos", "place")


@query
def decoded_boxes(spark, d):
    line = _t(spark, d, "lineitem")
    raw = line.select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 600).cast("double").alias("cx"), (F.col("l_suppkey") % 400 + 120).cast("double").alias("cy"),
        F.lit(40.0).alias("w"), F.lit(60.0).alias("h"), F.array(*(F.round(F.col(c) * m, 4) for c, m in (("l_discount", 5), ("l_tax", 5), ("l_discount", 5), ("l_quantity", 0.01)))).alias("scores"),
        F.lit(0.5).alias("ratio"), F.lit(0).alias("pad_x"), F.lit(140).alias("pad_y"),
    )
    return boxes.decode(raw, conf=0.3, classes=[0, 1, 2]).select("frame", "pos", "cls", "conf", "x1", "y1", "x2", "y2")


@query
def square_crop_geometry(spark, d):
    items = _t(spark, d, "items").where("x1 is not null").select("id", "x1", "y1", "x2", "y2").distinct()
    return items.select("id", boxes.square_crop(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.lit(1280), F.lit(720)).alias("s")).select("id", "s.*")


@query
def frame_geometry(spark, d):
    sizes = _t(spark, d, "videos").where("width > 0 and height > 0").select("width", "height").distinct()
    w, h = F.col("width"), F.col("height")
    return sizes.select("width", "height", boxes.letterbox(w, h).alias("l"), boxes.thumb_size(w, h).alias("t"), boxes.proxy_size(w, h).alias("p"), boxes.scaled(F.lit(333), F.lit(320), w).alias("drawn")).select(
        "width", "height", F.round("l.ratio", 6).alias("ratio"), "l.nw", "l.nh", "l.left", "l.top", F.col("t.h").alias("thumb_h"), F.col("p.w").alias("proxy_w"), F.col("p.h").alias("proxy_h"), "drawn"
    )


@query
def class_labels(spark, d):
    return _t(spark, d, "lineitem").select((F.col("l_partkey") % 30).alias("cls")).distinct().select("cls", boxes.label_of(F.col("cls")).alias("label"))


# --- tables and audit


def _videos(spark, d):
    latest = Window.partitionBy("id").orderBy(F.desc("indexed_at"), F.desc("removed_at"))
    v = _t(spark, d, "videos").withColumn("id", compared("id")).where("id is not null and indexed_at is not null").drop("removed_at_")
    return v.withColumn("r", F.row_number().over(latest)).where("r = 1").drop("r", "removed_at")


@query
def video_listing(spark, d):
    return tables.video_listing(_videos(spark, d)).select("id", "name", F.round("stats.duration_s", 2).alias("duration_s"), F.col("stats.motion.frames_seen").cast("double").alias("frames_seen"))


@query
def video_choices(spark, d):
    return tables.video_choices(_videos(spark, d))


@query
def library_summary(spark, d):
    return tables.library_summary(_videos(spark, d)).select("name", "id", "duration", "frames_seen", "items")


@query
def probed_videos(spark, d):
    raw = _videos(spark, d).select("id", F.when(F.col("width") != 640, F.col("fps")).alias("fps"), F.floor(F.col("duration") * F.col("fps")).alias("frame_count"))
    return tables.probe(raw).select("id", "fps", F.round("duration", 4).alias("duration"))


@query
def item_counts(spark, d):
    items = _t(spark, d, "items").select("id", compared("video_id").alias("video_id")).distinct()
    return items.groupBy("video_id").agg(F.count("*").alias("n"))


@query
def metadata_scan(spark, d):
    return tables.metadata(_t(spark, d, "items")).distinct()


@query
def embedding_export(spark, d):
    return tables.embeddings(_moments(spark, d), "3", "crop").select("id", F.round(F.aggregate("emb", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query
def embedding_export_all(spark, d):
    return tables.embeddings(_moments(spark, d)).select("id", F.round(F.aggregate("emb", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query
def frame_lookup(spark, d):
    frames = _t(spark, d, "items").where("kind = 'frame'").select(compared("video_id").alias("video_id"), "frame_idx", "thumb").distinct()
    wanted = _t(spark, d, "hits").select(compared("video_id").alias("video_id"), F.rint(F.col("t") * 25).cast("int").alias("frame_idx"))
    return tables.frame_at(frames, wanted)


@query
def upsert_videos(spark, d):
    base = _t(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("/v/"), "c_name").alias("path"), F.col("c_name").alias("name"), F.lit(25.0).alias("fps"), F.col("c_acctbal").alias("duration"),
        F.col("c_nationkey").alias("width"), F.lit(720).alias("height"), F.when(F.col("c_custkey") % 2 == 0, "old.mp4").alias("proxy_path"), F.lit(1.0).alias("indexed_at"), F.lit("{}").alias("stats_json"),
    )
    new = _t(spark, d, "supplier").select(
        (F.col("s_suppkey") * 3).cast("string").alias("id"), F.concat(F.lit("/w/"), "s_name").alias("path"), F.col("s_name").alias("name"), F.lit(30.0).alias("fps"), F.col("s_acctbal").alias("duration"),
        F.col("s_nationkey").alias("width"), F.lit(1080).alias("height"), F.when(F.col("s_suppkey") % 2 == 0, "new.mp4").alias("proxy_path"), F.lit(2.0).alias("indexed_at"), F.lit(None).cast("string").alias("stats_json"),
    )
    return store.upsert_videos(base, new)


@query
def set_proxy(spark, d):
    v = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_name", F.lit(None).cast("string").alias("proxy_path"))
    values = _t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("/proxy/"), "n_name").alias("value"))
    return store.set_column(v, values, "proxy_path")


@query
def clear_and_append(spark, d):
    items = _moments(spark, d).select("id", "video_id", "t", "kind", F.lit(None).cast("double").alias("conf"), "frame_idx")
    new = _t(spark, d, "supplier").select(F.lit("new").alias("video_id"), (F.floor(F.col("s_suppkey") / 4) * 0.5).alias("t"), F.when(F.col("s_suppkey") % 4 == 0, "frame").otherwise("crop").alias("kind"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") / 10000).alias("conf"), F.floor(F.col("s_suppkey") / 4).cast("int").alias("frame_idx"))
    return store.append_items(store.clear_video(items, ["2", "5"]), new, 1_000_000)


@query
def audit_tail(spark, d):
    return audit.audit_tail(_t(spark, d, "audit_log").select("seq", "time", "os_user", "query", "videos", "n_results", "verify").distinct(), 100).withColumn("n_results", F.col("n_results").cast("double"))


@query
def audit_appends(spark, d):
    """The last 500 lines of a log written in three appends of unequal size."""
    log = _t(spark, d, "audit_log").select("seq", "time", "os_user", "query", "videos", "n_results", "verify").distinct()
    path = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    most = log.agg(F.max("seq")).first()[0] or 0
    cuts = [-1, most // 7, most - most // 9, most]
    for low, high in zip(cuts[:-1], cuts[1:]):
        audit.write_audit(log.where((F.col("seq") > low) & (F.col("seq") <= high)).orderBy("seq").drop("seq"), path)
    last = audit.read_audit(spark, path, 500)
    return last.select("time", "os_user", "query", F.array_join("videos", ",").alias("videos"), F.col("n_results").cast("double").alias("n_results"), "verify")


@query
def video_by_id(spark, d):
    """One row of the video table, by id, for every id that some hit names."""
    named = _t(spark, d, "hits").select(compared("video_id").alias("id")).where("id is not null").distinct()
    return tables.video(_videos(spark, d), named).select("id", "name", F.round("duration", 3).alias("duration"))


@query
def answer_fallback(spark, d):
    """The probability of yes from the answer where the token probabilities give none."""
    e = _t(spark, d, "events")
    p = F.when(F.col("event_id") % 3 == 0, F.round(F.col("value") / 1000, 6))
    answer = F.when(F.col("event_id") % 4 == 0, "yes").when(F.col("event_id") % 4 == 1, "no")
    return e.select("event_id", text.p_yes_or_answer(p, answer).alias("p_yes"))


@query
def compute_units(spark, d):
    """Profile rows by compute unit: number, milliseconds and megabytes."""
    e = _t(spark, d, "events").select(F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("compute_unit"), (F.col("value") * 1000).cast("long").alias("us"), (F.col("user_id") * 4096).cast("long").alias("bytes"))
    return report.unit_summary(e)


@query
def audit_video_names(spark, d):
    videos = _t(spark, d, "videos").select(compared("id").alias("video_id"), "name").groupBy("video_id").agg(F.min("name").alias("name"))
    used = _t(spark, d, "audit_log").select(F.explode("videos").alias("v")).select(compared("v").alias("video_id")).distinct()
    return videos.join(used, "video_id", "left_semi")
