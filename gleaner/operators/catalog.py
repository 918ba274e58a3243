"""Galleries, manifests, page caches and the nested snapshot record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.scalar import valid_role
from gleaner.operators.scan import GROUP_ROWS, has_large_group, in_chunks, running
from gleaner.operators.sizes import small_or_not

SCHEMA_VERSION = "0.2.0"
#: File types of card art, and name parts of files that are none.
ART_TYPES = (".png", ".jpg", ".jpeg", ".webp")
NOT_ART = ("edit", "license", "cc-", "wiki.png", "logo", "favicon", "ambox", "commons", "disambig", "padlock", "question")


def aliased(rows: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """`rows` with `identity`: the alias table's (alias, canonical) name, or the name itself."""
    return rows.join(small_or_not(aliases, 64), F.col(name) == F.col("alias"), "left").withColumn("identity", F.coalesce("canonical", name)).drop("alias", "canonical")


def gallery_counts(entries: DataFrame, role: str, identity: str) -> DataFrame:
    """Per role: references, identities, and the sorted distinct names."""
    return entries.groupBy(role).agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct(identity).alias("n_identities"), F.array_join(F.sort_array(F.collect_set(identity)), ",").alias("names"))


def is_card_art(name: Column) -> Column:
    low = F.lower(name)
    typed, hinted = F.lit(False), F.lit(False)
    for t in ART_TYPES:
        typed = typed | low.endswith(t)
    for h in NOT_ART:
        hinted = hinted | F.contains(low, F.lit(h))
    return typed & ~hinted


def uncached(wanted: DataFrame, cached: DataFrame, title: str) -> DataFrame:
    """Titles still to fetch."""
    return wanted.join(cached.select(title), title, "left_anti")


def batches(titles: DataFrame, title: str, group: str, size: int = 40, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(group, batch, n, first, last): titles of each group in order, `size` to a request. A group of more than `group_rows` titles is numbered in chunks."""
    if has_large_group(titles, group, group_rows):
        place = running(in_chunks(titles, group, [title], group_rows), group, [title], F.lit(1), "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size))
    else:
        place = titles.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(title)) - 1) / size))
    return place.groupBy(group, "batch").agg(F.count(F.lit(1)).alias("n"), F.min(title).alias("first"), F.max(title).alias("last"))


def manifest(entries: DataFrame, role: str, identity: str, file: str) -> DataFrame:
    """One row a role: (role, entries: map of identity to its sorted files)."""
    files = entries.groupBy(role, identity).agg(F.sort_array(F.collect_list(file)).alias("files"))
    return files.groupBy(role).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(identity, "files")))).alias("entries"))


def manifest_summary(entries: DataFrame, role: str, identity: str, file: str) -> DataFrame:
    """Per role: identities and files. Counts alone: the manifest's maps are made only where they are written."""
    return entries.groupBy(role).agg(F.countDistinct(identity).alias("n_identities"), F.count(file).alias("n_files"))


def skipped_union(*names: DataFrame) -> DataFrame:
    """Distinct names of one-column tables, in order."""
    out = names[0]
    for other in names[1:]:
        out = out.union(other)
    return out.distinct().orderBy(out.columns[0])


def write_manifest(manifests: DataFrame, skipped: DataFrame, path: str) -> None:
    """One JSON document: roles with their entries, and the sorted names of skipped images. For a gallery, whose size a person can look through."""
    role = manifests.columns[0]
    in_order = lambda a, b: F.when(a[role] < b[role], -1).when(a[role] > b[role], 1).otherwise(0)
    roles = manifests.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(*manifests.columns)), in_order)).alias("roles"))
    names = skipped.distinct().groupBy().agg(F.sort_array(F.collect_list(skipped.columns[0])).alias("n")).scalar()
    roles.select(F.to_json(F.struct("roles", names.alias("skipped_images"))).alias("value")).coalesce(1).write.text(path)


def stem_lookup(wanted: DataFrame, prefix: str, files: DataFrame, path: str) -> DataFrame:
    """(prefix, path) of each wanted prefix: the first path, in order, whose file stem starts with it; null if none does.

    Stems are cut to the lengths that the prefixes have, so the match is a hash join.
    """
    lengths = wanted.select(F.length(prefix).alias("n")).distinct().groupBy().agg(F.sort_array(F.collect_list("n")).alias("all")).scalar()
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    cut = files.select(F.col(path).alias("_p"), stem.alias("_s"), lengths.alias("_all")).select("_p", "_s", F.explode("_all").alias("_n")).where(F.length("_s") >= F.col("_n"))
    heads = cut.select("_p", F.left("_s", F.col("_n")).alias("_head"))
    first = heads.groupBy("_head").agg(F.min("_p").alias("path"))
    return wanted.select(prefix).join(first, F.col(prefix) == F.col("_head"), "left").select(prefix, "path")


def zipped(boxes: DataFrame, identities: DataFrame, frame: str, slot: str) -> DataFrame:
    """Boxes with the identities of the same frame and place in order; a frame that has not as many of both is an error."""
    both = boxes.withColumn("_box", F.lit(True)).join(identities.withColumn("_name", F.lit(True)), [frame, slot], "full")
    whole = F.col("_box").isNotNull() & F.col("_name").isNotNull()
    odd = F.raise_error(F.concat(F.lit("boxes and identities differ in number in frame "), F.col(frame).cast("string")))
    return both.where(F.when(whole, F.lit(True)).otherwise(odd.cast("boolean"))).drop("_box", "_name")


def snapshots(frames: DataFrame, cards: DataFrame, frame: str) -> DataFrame:
    """frames (frame, state, w, h) and cards (frame, slot, identity, role, confidence, x, y, w, h) -> one nested record a frame.

    A frame that is not a board has no cards. An invalid role is read as unknown; the identity stays.
    """
    card = F.struct(
        "slot", F.array("x", "y", "w", "h").alias("bbox_rel"), valid_role(F.col("role")).alias("role_class"), "identity",
        F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("string").alias("state")).alias("readings"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )
    nested = cards.groupBy(frame).agg(F.sort_array(F.collect_list(card)).alias("_cards"))
    out = frames.join(nested, frame, "left")
    board = (F.col("state") == "board") & F.col("_cards").isNotNull()
    kind = out.schema["_cards"].dataType
    return out.select(
        frame, F.struct(F.col("w").alias("w"), F.col("h").alias("h")).alias("resolution"), F.col("state").alias("frame_state"), F.when(board, F.col("_cards")).otherwise(F.array().cast(kind)).alias("cards"), F.lit(SCHEMA_VERSION).alias("schema_version")
    )


def summary_line(stem: Column, state: Column, cards: Column) -> Column:
    """`stem  state=...  cards=N  identity@conf ...`."""
    head = F.format_string("%-35s  state=%-7s  cards=%d", stem, state, F.size(cards))
    named = F.array_join(F.transform(cards, lambda c: F.format_string("%s@%.2f", c["identity"], c["confidence"])), "  ")
    return F.when(F.size(cards) > 0, F.concat(head, F.lit("  "), named)).otherwise(head)


def crop_file(stem: Column, index: Column, seconds: Column, slot: Column) -> Column:
    return F.format_string("%s_%06d_t%07.1fs_s%02d.png", stem, index, seconds, slot)


def write_snapshots(records: DataFrame, path: str, frame: str | None = None) -> None:
    """One JSON document a line; with `frame`, a folder a frame, of one document each."""
    value = F.to_json(F.struct("*")).alias("value")
    if frame is None:
        records.select(value).write.text(path)
    else:
        records.select(F.col(frame).alias("frame"), value).write.partitionBy("frame").text(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON document a row, with nulls: a crop manifest or a session's frames."""
    rows.write.option("ignoreNullFields", False).json(path)


def write_session(captures: DataFrame, counters: DataFrame, path: str) -> None:
    """A recorded session: `frames`, a line a frame, and `session`, a line a session with its counters."""
    write_lines(captures, f"{path}/frames")
    write_lines(counters, f"{path}/session")


def fused(readings: DataFrame, slot: str, identity: str, margin: str, seconds: str, decay: float) -> DataFrame:
    """(slot, identity, weight, lead): the identity with the most margin, each reading decayed by its age against the slot's newest."""
    newest = readings.groupBy(slot).agg(F.max(seconds).alias("_now"))
    weighed = readings.join(newest, slot).groupBy(slot, identity).agg(F.sum(F.col(margin) * F.exp(-decay * (F.col("_now") - F.col(seconds)))).alias("weight"))
    top = weighed.groupBy(slot).agg(F.slice(F.sort_array(F.collect_list(F.struct("weight", identity)), asc=False), 1, 2).alias("t"))
    return top.select(slot, F.get("t", F.lit(0))[identity].alias(identity), F.get("t", F.lit(0))["weight"].alias("weight"), (F.get("t", F.lit(0))["weight"] - F.coalesce(F.get("t", F.lit(1))["weight"], F.lit(0.0))).alias("lead"))
