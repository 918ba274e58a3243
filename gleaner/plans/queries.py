"""One query an operator, over the tables as `gleaner.sources.tables` views them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import scalar
from gleaner.operators import boxes, catalog, frames, fusion, identify, resample, vectors
from gleaner.operators.durable import shared_folder
from gleaner.plans import pipeline
from gleaner.sources import files
from gleaner.sources import tables as T

#: Ticks and thinning of the event sessions: one in six hours.
FPS = 1 / 21600
DEDUP_BITS = 28


def proto_mean(spark: SparkSession, d: str) -> DataFrame:
    return vectors.prototypes(T.table(spark, d, "embeddings"), ["label"]).select("label", F.posexplode("proto").alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("x"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "embeddings")
    return vectors.nearest(e, vectors.prototypes(e, ["label"]), ["vec_id", "label"])


def margin_nn(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("vec_id", "identity", "confidence")


def margin_abstain_stats(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("margin"), 6).alias("mean_margin"))


def interproto_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = vectors.off_diagonal(vectors.prototypes(T.table(spark, d, "embeddings"), ["label"]))
    return stats.select(*[F.round(c, 6).alias(c) for c in stats.columns])


def top1_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).agg(F.round(F.avg((F.col("best") == F.col("label").cast("string")).cast("double")), 6).alias("accuracy"), F.round(F.avg("margin"), 6).alias("mean_margin"))


def parity_max_abs_diff(spark: SparkSession, d: str) -> DataFrame:
    """Float vectors' cells against the unit vectors in double: the largest difference, and whether it is small enough."""
    e = T.table(spark, d, "embeddings")
    x = e.select(F.explode(F.zip_with("embedding", scalar.unit(F.col("embedding")), lambda a, b: F.abs(a.cast("double") - b))).alias("diff"))
    return x.agg(F.round(F.max("diff"), 9).alias("max_diff"), (F.max("diff") < 1e-4).alias("same"), F.count(F.lit(1)).alias("n"))


def dhash_grid(spark: SparkSession, d: str) -> DataFrame:
    return T.hashes(spark, d)


#: Pictures of a size that neither nine nor eight divides.
PICTURE_W, PICTURE_H = 70, 61


def picture_dhash(spark: SparkSession, d: str) -> DataFrame:
    """Line items as pixels of a supplier's picture."""
    p = T.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("frame"), (F.col("l_partkey") % PICTURE_W).alias("x"), (F.col("l_orderkey") % PICTURE_H).alias("y"), F.col("l_quantity").cast("long").alias("v"))
    return frames.picture_hashes(p, "frame", F.lit(PICTURE_W), F.lit(PICTURE_H))


def hamming_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each hash to the one before it in its video."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return T.hashes(spark, d).withColumn("was", F.lag("dhash").over(w)).where("was is not null").select("vec_id", scalar.hamming(F.col("dhash"), F.col("was")).alias("bits"))


def dedup_last_kept(spark: SparkSession, d: str) -> DataFrame:
    return frames.dedup_last_kept(T.hashes(spark, d), "label", ["vec_id"], "dhash", DEDUP_BITS).select("label", "vec_id", "kept")


def select_board_frames(spark: SparkSession, d: str) -> DataFrame:
    """Dedup, then the state filter: a third of the frames are menus, which still anchor."""
    state = F.when(F.col("vec_id") % 3 == 0, "menu").otherwise("board")
    return frames.select_frames(T.hashes(spark, d).withColumn("state", state), "label", ["vec_id"], DEDUP_BITS).select("label", "vec_id")


def orb_ratio_count(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors of each video with a distinctive nearest prototype hash."""
    e = T.table(spark, d, "embeddings")
    refs = vectors.prototypes(e, ["label"]).select(F.col("label").alias("ref"), vectors.vector_hash(F.col("proto")).alias("ref_hash"))
    rows = T.hashes(spark, d)
    found = vectors.ratio_matches(rows, refs, ["vec_id"], "dhash", "ref", "ref_hash", 0.95)
    return found.groupBy("d1").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"))


def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    fps = F.when(F.col("user_id") % 3 == 0, 30.0).when(F.col("user_id") % 3 == 1, 60.0).otherwise(25.0)
    out = frames.strided(T.captures(spark, d), fps, F.lit(1.5), "event_id")
    return out.select("event_id", "stride", F.round("timestamp_s", 6).alias("timestamp_s"))


def strided_files(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as numbered frame files of a nation's video, written out and scanned by stride from the tenth on."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    s = T.table(spark, d, "supplier")
    files.write_frames(s.select(F.concat(F.lit("n"), "s_nationkey").alias("video"), F.col("s_suppkey").alias("frame_index"), F.col("s_name").cast("binary").alias("content")), folder)
    found = files.strided_files(spark, folder, 3, 24.0).where("frame_index >= 10")
    return found.select("video", "frame_index", F.round("timestamp_s", 6).alias("timestamp_s"), F.col("content").cast("string").alias("content"))


def media_fps(spark: SparkSession, d: str) -> DataFrame:
    probe = F.concat((F.col("event_id") % 61).cast("string"), F.lit("/"), (F.col("event_id") % 3).cast("string"))
    rate, source = scalar.media_fps(F.col("value") * 5 - 100, probe)
    return T.captures(spark, d).select("event_id", F.round(rate, 6).alias("fps"), source.alias("fps_source"))


def asof_resample(spark: SparkSession, d: str) -> DataFrame:
    return resample.resampled(T.captures(spark, d), "user_id", "event_id", "seconds", FPS).select("user_id", "tick", "event_id")


def cfr_dup_flags(spark: SparkSession, d: str) -> DataFrame:
    return resample.dup_counts(T.captures(spark, d), "user_id", "event_id", "seconds", FPS)


def cfr_dropped(spark: SparkSession, d: str) -> DataFrame:
    return resample.dropped(T.captures(spark, d), "user_id", "event_id", "seconds", FPS)


def session_counters(spark: SparkSession, d: str) -> DataFrame:
    out = resample.counters(T.captures(spark, d), "user_id", "event_id", "seconds", FPS, "event_type")
    return out.withColumn("sizes", F.array_join("sizes", ","))


def thin_max_fps(spark: SparkSession, d: str) -> DataFrame:
    return frames.thinned(T.captures(spark, d), "user_id", ["seconds", "event_id"], "seconds", FPS).where("kept").select("user_id", "event_id")


def segment_islands(spark: SparkSession, d: str) -> DataFrame:
    return resample.segments(T.captures(spark, d), "user_id", ["seconds", "event_id"], "event_type").select("event_id", "segment", "segment_frame")


def capture_fps(spark: SparkSession, d: str) -> DataFrame:
    return resample.capture_fps(T.captures(spark, d), "user_id", "seconds").select("user_id", "n", F.round(F.col("fps") * 86400, 6).alias("frames_per_day"))


def wall_align(spark: SparkSession, d: str) -> DataFrame:
    epoch = F.lit(1704067200.0)
    return T.captures(spark, d).select("event_id", resample.wall_frame(F.col("seconds"), epoch, F.lit(0.5)).alias("frame_index"), resample.even((F.col("event_id") % 1001).cast("int")).alias("even_w"))


def json_readings(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "k int")
    return T.captures(spark, d).groupBy("event_type").agg(F.sum(parsed["k"]).alias("k_sum"), F.count(parsed["k"]).alias("k_n"))


def temporal_fusion(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.fused(T.captures(spark, d), "user_id", "event_type", "value", "seconds", 1e-6)
    return out.select("user_id", "event_type", F.round("weight", 4).alias("weight"), F.round("lead", 4).alias("lead"))


#: Windows of ten days; votes fade to a half in about eight.
FUSION_WINDOW, FUSION_RULES = 864000.0, fusion.Rules(decay=1e-6, support=0.9, confident=0.3, flips=2)


def fused_windows(spark: SparkSession, d: str) -> DataFrame:
    out = fusion.fused(*T.board_reads(spark, d), "user_id", FUSION_WINDOW, FUSION_RULES)
    return out.select("user_id", "window", "slot", "identity", *[F.round(c, 4).alias(c) for c in ("confidence", "support")], "revealed", "last_seen_frame", "staleness_frames", "fused_from", "first_frame", "last_frame")


def box_area_aspect(spark: SparkSession, d: str) -> DataFrame:
    return boxes.shaped(T.boxes(spark, d), F.lit(T.FRAME_W), F.lit(T.FRAME_H)).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


def hud_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return boxes.outside_zones(T.boxes(spark, d)).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.min("box_id").alias("first_box"))


def iou_nms(spark: SparkSession, d: str) -> DataFrame:
    return boxes.suppressed(boxes.outside_zones(T.boxes(spark, d)), "frame", "box_id").select("frame", "slot", "box_id")


def iou_semijoin(spark: SparkSession, d: str) -> DataFrame:
    b = T.boxes(spark, d)
    return boxes.overlapped(b, b.where("l_quantity > 45"), "frame", 0.15).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


def crop_pixels(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.lit(T.FRAME_W), F.lit(T.FRAME_H)
    c = boxes.crop(T.boxes(spark, d), w, h)
    r0, r1, c0, c1 = boxes.art_band(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    out = c.select("frame", "x0", "y0", "x1", "y1", "empty", ((r1 - r0) * (c1 - c0)).alias("band"))
    return out.groupBy("frame").agg(*[F.sum(x).alias(x) for x in ("x0", "y0", "x1", "y1", "band")], F.count_if("empty").alias("n_empty"))


def overlay_pixels(spark: SparkSession, d: str) -> DataFrame:
    return boxes.overlay(T.boxes(spark, d), F.lit(640), F.lit(360)).groupBy("frame").agg(F.max("x0").alias("x0"), F.max("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def gate_case(spark: SparkSession, d: str) -> DataFrame:
    s = frames.region_stats(T.pixels(spark, d), "frame", F.lit(64), F.lit(64))
    return s.select("frame", *[F.round(c, 6).alias(c) for c in ("mean", "center", "ring")], frames.gate(F.col("mean"), F.col("center"), F.col("ring")).alias("state"))


def red_shift(spark: SparkSession, d: str) -> DataFrame:
    return frames.red_shift(T.pixels(spark, d), "frame").select("frame", F.round("red_shift", 6).alias("red_shift"), "tinted")


def hs_histogram(spark: SparkSession, d: str) -> DataFrame:
    return frames.hs_histogram(T.pixels(spark, d).withColumn("v", F.col("val")), "frame").select("frame", "bin", F.round("share", 6).alias("share"))


def hist_corr_top2(spark: SparkSession, d: str) -> DataFrame:
    """Frames against shots; the pixels that a frame has in a shot stand in for keypoint matches."""
    p = T.pixels(spark, d).withColumn("v", F.col("val"))
    crops = p.select("frame").distinct().join(frames.histogram_vectors(frames.hs_histogram(p, "frame"), "frame"), "frame", "left")
    top = vectors.two_best(crops, ["frame"], "vector", frames.histogram_vectors(frames.hs_histogram(p, "shot"), "shot"), "shot", "vector", digits=9)
    clamp = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    matches = p.groupBy("frame", F.col("shot").cast("string").alias("shot")).agg(F.count(F.lit(1)).alias("n"))
    side = lambda name, n: matches.select("frame", F.col("shot").alias(name), F.col("n").alias(n))
    both = top.join(side("best", "n1"), ["frame", "best"], "left").join(side("second", "n2"), ["frame", "second"], "left")
    identity, score = identify.correlated(clamp("top1"), clamp("top2"), F.col("best"), F.col("second"), F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0)))
    return both.select("frame", identity.alias("identity"), score.alias("score"))


def ensemble_combine(spark: SparkSession, d: str) -> DataFrame:
    out = identify.combined(*T.verdicts(spark, d), "doc_id")
    return out.select("doc_id", "identity", "role", F.round("confidence", 4).alias("confidence"), "source")


def tint_discount(spark: SparkSession, d: str) -> DataFrame:
    c, _ = T.verdicts(spark, d)
    role = F.get(F.array(*map(F.lit, (*scalar.ROLES, "dealer"))), (F.col("doc_id") % 6).cast("int"))
    identity, role, confidence = identify.tint_discounted(F.col("identity"), scalar.valid_role(role), F.col("confidence"), F.col("doc_id") % 2 == 0)
    return c.select("doc_id", identity.alias("identity"), role.alias("role"), confidence.alias("confidence"))


def _paired(spark: SparkSession, d: str) -> DataFrame:
    c, e = T.verdicts(spark, d)
    return c.withColumnRenamed("identity", "classical").join(e.select("doc_id", F.col("identity").alias("embedding")), "doc_id")


def mining_rollup(spark: SparkSession, d: str) -> DataFrame:
    return identify.mining_stats(_paired(spark, d), "source", "doc_id", "classical", "embedding")


def head_to_head(spark: SparkSession, d: str) -> DataFrame:
    return identify.head_to_head(_paired(spark, d), "classical", "embedding")


def gallery_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.gallery_counts(T.gallery(spark, d), "role", "identity")


def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth nation is another name of the nation before it."""
    n = T.table(spark, d, "nation")
    aliases = n.where("n_nationkey % 5 = 4").select(F.col("n_name").alias("alias"), F.concat(F.lit("NATION_"), (F.col("n_nationkey") - 1).cast("string")).alias("canonical"))
    return catalog.aliased(T.gallery(spark, d).withColumnRenamed("identity", "raw"), aliases, "raw").groupBy("identity").agg(F.count(F.lit(1)).alias("n"))


def slugify_urls(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "pages").select("page_id", scalar.slugify(F.col("url")).alias("slug"))


def art_filter(spark: SparkSession, d: str) -> DataFrame:
    names = ("logo.PNG", "card.webp", "icon.png", "cc-by.jpg", "portrait.JPEG", "notes.txt")
    file = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names)).cast("int")))
    return T.table(spark, d, "part").select("p_partkey", catalog.is_card_art(file).alias("is_art"))


def uncached_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = T.table(spark, d, "pages").select(F.col("page_id").alias("title"))
    return catalog.uncached(pages, pages.where("title % 3 = 0"), "title")


def title_batches(spark: SparkSession, d: str) -> DataFrame:
    return catalog.batches(T.table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand")


def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.manifest_summary(T.gallery(spark, d), "role", "identity", "file")


def filename_parse(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 4
    stem = F.when(kind == 0, F.format_string("v%d_%03d_t%05ds", "user_id", "event_id", F.floor("value").cast("long"))).when(kind == 1, F.concat(F.lit("clip"), F.col("event_id").cast("string")))
    stem = stem.when(kind == 2, F.concat(F.lit("v_x"), F.col("event_id").cast("string"), F.lit("_t1.5s"))).otherwise(F.concat(F.lit("v_"), F.col("event_id").cast("string"), F.lit("_tts")))
    video, index, seconds = scalar.frame_name(stem)
    return T.captures(spark, d).select("event_id", video.alias("video"), index.alias("frame_index"), seconds.alias("timestamp_s"))


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "board").when(F.col("o_orderstatus") == "F", "modal").otherwise("menu")
    f = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("frame"), state.alias("state"), F.lit(T.FRAME_W).alias("w"), F.lit(T.FRAME_H).alias("h"))
    kept = boxes.suppressed(T.boxes(spark, d), "frame", "box_id")
    cards = kept.select("frame", "slot", F.concat(F.lit("id"), (F.col("box_id") % 9).cast("string")).alias("identity"), F.when(F.col("slot") % 2 == 0, "demon").otherwise("dealer").alias("role"), (F.col("box_id") % 100 / 100.0).alias("confidence"), "x", "y", "w", "h")
    return catalog.snapshots(f, cards, "frame")


def snapshot_nest(spark: SparkSession, d: str) -> DataFrame:
    roles = F.array_join(F.transform("cards", lambda c: F.concat(c["role_class"], F.lit(":"), c["identity"])), ",")
    return _snapshots(spark, d).select("frame", "frame_state", F.size("cards").alias("n_cards"), roles.alias("cards"), "schema_version")


def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    stem = F.concat(F.lit("frame"), F.col("frame").cast("string"))
    return _snapshots(spark, d).select("frame", catalog.summary_line(stem, F.col("frame_state"), F.col("cards")).alias("line"))


def crop_names(spark: SparkSession, d: str) -> DataFrame:
    return T.captures(spark, d).select("event_id", catalog.crop_file(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_id"), F.floor("value").cast("double"), (F.col("event_id") % 12).cast("int")).alias("name"))


def iso_time(spark: SparkSession, d: str) -> DataFrame:
    return T.captures(spark, d).select("event_id", scalar.iso_time(F.col("seconds")).alias("at"))


def zip_identities(spark: SparkSession, d: str) -> DataFrame:
    """Line items as boxes and as names of the same order and line."""
    b = T.boxes(spark, d).withColumn("slot", F.col("l_linenumber").cast("long"))
    names = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("slot"), F.col("l_returnflag").alias("identity"))
    one = b.groupBy("frame", "slot").agg(F.max("w").alias("w"))
    return catalog.zipped(one, names.groupBy("frame", "slot").agg(F.max("identity").alias("identity")), "frame", "slot").groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("w"))


def frame_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 captures of each session: the limit is the operator."""
    return frames.first_of(T.captures(spark, d), "user_id", ["seconds", "event_id"], 20).select("user_id", "event_id")


def skipped_union(spark: SparkSession, d: str) -> DataFrame:
    part = T.table(spark, d, "part")
    return catalog.skipped_union(part.select(F.col("p_brand").alias("name")), part.select(F.col("p_type").alias("name")), part.select(F.col("p_brand").alias("name")))


def stem_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's segment and nation as a file; each nation's first file by a prefix of its name."""
    files = T.table(spark, d, "customer").select(F.concat(F.lit("dir/"), F.lower("c_mktsegment"), F.lit("_"), F.col("c_nationkey").cast("string"), F.lit("_"), F.col("c_custkey").cast("string"), F.lit(".png")).alias("path"))
    wanted = T.table(spark, d, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit("_"), F.col("c_nationkey").cast("string"), F.lit("_")).alias("prefix")).distinct()
    return catalog.stem_lookup(wanted, "prefix", files, "path")


def localize_blobs(spark: SparkSession, d: str) -> DataFrame:
    """A coloured card on a grey frame a supplier, found by colours, morphology, components and the box filters."""
    return pipeline.localized(T.blob_frames(spark, d), "frame").select("frame", "slot", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")])


def pipeline_records(spark: SparkSession, d: str) -> DataFrame:
    """The same frames through all steps: gate, localizer, crops, the classical identifier on coloured references, assembly."""
    out = pipeline.run(T.blob_frames(spark, d), "frame", pipeline.classical_identifier(T.colour_gallery(spark, d)))
    card = F.get("cards", F.lit(0))
    return out.select("frame", "frame_state", F.size("cards").alias("n_cards"), card["identity"].alias("identity"), card["role_class"].alias("role"), card["confidence"].alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (
        proto_mean, margin_nn, margin_abstain_stats, interproto_stats, top1_accuracy, parity_max_abs_diff, dhash_grid, picture_dhash, hamming_neighbours, dedup_last_kept, select_board_frames, orb_ratio_count, stride_sample, strided_files, media_fps,
        asof_resample, cfr_dup_flags, cfr_dropped, session_counters, thin_max_fps, segment_islands, capture_fps, wall_align, json_readings, temporal_fusion, fused_windows, box_area_aspect, hud_antijoin, iou_nms, iou_semijoin, crop_pixels,
        overlay_pixels, gate_case, red_shift, hs_histogram, hist_corr_top2, ensemble_combine, tint_discount, mining_rollup, head_to_head, gallery_counts, alias_resolve, slugify_urls, art_filter, uncached_pages, title_batches,
        manifest_summary, filename_parse, snapshot_nest, summary_lines, crop_names, iso_time, zip_identities, frame_limit, skipped_union, stem_lookup, localize_blobs, pipeline_records,
    )
}
