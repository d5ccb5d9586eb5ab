"""Readers that turn capture files and nested documents into tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipledger.functions.rules import Rule, apply_gates
from clipledger.functions.text import rational, stem
from clipledger.operators.groups import PART_BITS, by_group
from clipledger.session import join_same, settle

PROBE = (
    "struct<streams: array<struct<codec_type: string, codec_name: string, width: int, height: int, duration: string, avg_frame_rate: string, "
    "r_frame_rate: string, nb_frames: string, pix_fmt: string, bit_rate: string, color_space: string, color_transfer: string, color_primaries: string, "
    "tags: map<string, string>, side_data_list: array<struct<rotation: double>>>>, format: struct<duration: string, start_time: string, format_name: string, "
    "bit_rate: string, tags: map<string, string>>>"
)
FRAME = "struct<candidate_index: int, source_frame_index: bigint, timestamp_s: double, path: string, width: int, height: int, metrics: map<string, double>, selection_rank: int>"
ANALYSIS = f"struct<schema_version: string, metadata: map<string, string>, frames: array<{FRAME}>, keyframes: array<{FRAME}>, warnings: array<string>>"


def media_catalog(probes: DataFrame, clip: str, probe: str) -> DataFrame:
    """One row per clip from the probe tool's JSON text: the first video stream, rational rates, display size after
    rotation, any-audio flag, and a gate that rejects clips without a usable duration, rate or size."""
    d = probes.select(clip, F.from_json(probe, PROBE).alias("_j"))
    d = d.select(clip, "_j", F.get(F.filter("_j.streams", lambda s: s["codec_type"] == "video"), F.lit(0)).alias("_v"))
    v = F.col("_v")
    tag = v["tags"]["rotate"].try_cast("double")
    side = F.get(F.filter(F.transform(v["side_data_list"], lambda s: s["rotation"]), lambda r: r.isNotNull()), F.lit(0))
    rotation = F.coalesce(F.pmod(F.rint(F.coalesce(tag, side)).cast("int"), F.lit(360)), F.lit(0))
    nonzero = lambda a, b: F.when(a > 0, a).otherwise(b)
    d = d.select(
        clip, v.isNotNull().alias("has_video"), nonzero(rational(v["duration"]), rational(F.col("_j.format.duration"))).alias("duration_s"),
        rational(F.col("_j.format.start_time")).alias("start_time_s"), nonzero(rational(v["avg_frame_rate"]), rational(v["r_frame_rate"])).alias("fps"),
        v["width"].alias("width"), v["height"].alias("height"), rotation.alias("rotation_degrees"), v["nb_frames"].try_cast("long").alias("frame_count"),
        F.coalesce(v["codec_name"], F.lit("unknown")).alias("codec"), v["pix_fmt"].alias("pixel_format"), F.coalesce(v["bit_rate"].try_cast("long"), F.col("_j.format.bit_rate").try_cast("long")).alias("bit_rate_bps"),
        v["color_space"].alias("color_space"), v["color_transfer"].alias("color_transfer"), v["color_primaries"].alias("color_primaries"),
        F.coalesce(v["tags"]["creation_time"], F.col("_j.format.tags")["creation_time"]).alias("creation_time"), F.coalesce("_j.format.format_name", F.lit("unknown")).alias("container"),
        F.coalesce(F.exists("_j.streams", lambda s: s["codec_type"] == "audio"), F.lit(False)).alias("has_audio"))
    turned = F.col("rotation_degrees").isin(90, 270)
    d = d.withColumn("display_width", F.when(turned, F.col("height")).otherwise(F.col("width"))).withColumn("display_height", F.when(turned, F.col("width")).otherwise(F.col("height")))
    return apply_gates(d, [
        Rule("no_video_stream", ~F.col("has_video")), Rule("no_duration", F.col("duration_s") <= 0), Rule("no_frame_rate", F.col("fps") <= 0),
        Rule("invalid_dimensions", (F.col("width") <= 0) | (F.col("height") <= 0))])


def parse_analysis(docs: DataFrame, clip: str, text: str, which: str = "frames") -> DataFrame:
    """Rows of one frame list of the clips' analysis documents, with their position. A document that does not parse
    gives one row with a null frame, so that it can be reported."""
    d = docs.select(clip, F.from_json(text, ANALYSIS).alias("_a"))
    return d.select(clip, F.col("_a.schema_version").alias("schema_version"), F.posexplode_outer(f"_a.{which}").alias("position", "frame"))


def read_analysis(spark: SparkSession, paths: str | Sequence[str], which: str = "frames") -> DataFrame:
    """Frame rows of analysis files, keyed by file path, in the form of :func:`parse_analysis`.

    Files as the writer lays them out (two blanks a level, so that a line tells its depth) are read by blocks: a large
    file goes to many tasks, and only the lines of one frame are gathered. Other files are parsed whole.
    """
    d = numbered_lines(spark, paths)
    head = F.nullif(F.regexp_extract("value", r'^  "(\w+)":', 1), F.lit(""))
    d = running_in_files(d.withColumn("_head", head), _frames=F.col("value").rlike(r"^    \{").cast("long"))
    d = settle(carried_in_files(d, "_head"))
    versions = d.where("_head = 'schema_version'").select("file", F.regexp_extract("value", r'^  "schema_version": "([^"]*)"', 1).alias("schema_version"))
    lists = d.where(F.col("_head") == which)
    opened = F.col("value").rlike(r"^    \{")
    first = lists.where(opened).groupBy("file").agg(F.min("_frames").alias("_first"))
    lines = lists.where(F.col("value").rlike(r"^     +\S") | F.col("value").rlike(r"^    [{}],?$"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    one = join_same(lines.where("_frames > 0").groupBy("file", "_frames").agg(text.alias("_t")), first, ["file"])
    laid = join_same(one, versions, ["file"], "left").select(
        F.col("file").alias("clip"), "schema_version", (F.col("_frames") - F.col("_first")).cast("int").alias("position"), F.from_json(F.regexp_replace("_t", ",$", ""), FRAME).alias("frame"))
    # files without that layout, or without the list
    rest = join_same(d.select("file").distinct(), first.select("file"), ["file"], "left_anti")
    whole = join_same(d.select("file", "line", "value"), rest, ["file"], "left_semi").groupBy("file").agg(text.alias("_t"))
    return laid.unionByName(parse_analysis(whole.withColumnRenamed("file", "clip"), "clip", "_t", which))


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of text files as the splittable reader gives them, with ``file``, ``block`` (where the reader's byte range
    begins) and ``line``, their number in the file from 0: a task numbers its ranges, and the lines of earlier ranges
    are added from one row per range."""
    d = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"), "value")
    own = Window.partitionBy("file", "block").orderBy("_at")
    d = d.withColumn("_i", F.row_number().over(own) - 1)
    return _after_blocks(d, {"line": (F.count("*"), F.col("_i"))}).drop("_at", "_i")


def _after_blocks(d: DataFrame, sums: dict) -> DataFrame:
    """Add columns: a running number within a block plus the total of the file's earlier blocks."""
    blocks = d.groupBy("file", "block").agg(*[total.alias(n) for n, (total, _) in sums.items()])
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    out = join_same(d, blocks, ["file", "block"])
    return out.withColumns({n: F.col(f"_{n}") + own for n, (_, own) in sums.items()}).drop(*[f"_{n}" for n in sums])


def running_in_files(d: DataFrame, **cols: Column) -> DataFrame:
    """Add running sums over the lines of each file, up to and including a line. Windows hold one block."""
    own = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[c.alias(f"__{n}") for n, c in cols.items()])
    d = d.select("*", *[F.sum(f"__{n}").over(own).alias(f"_own_{n}") for n in cols])
    out = _after_blocks(d, {n: (F.sum(f"__{n}"), F.col(f"_own_{n}")) for n in cols})
    return out.drop(*[f"__{n}" for n in cols], *[f"_own_{n}" for n in cols])


def carried_in_files(d: DataFrame, name: str) -> DataFrame:
    """Fill nulls of a column from the last line of the file that has a value."""
    own = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    last = d.groupBy("file", "block").agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col("line"))).alias("_l"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("file", "block", F.last("_l", ignorenulls=True).over(earlier).alias("_before"))
    out = join_same(d.withColumn("_own", F.last(name, ignorenulls=True).over(own)), last, ["file", "block"])
    return out.withColumn(name, F.coalesce("_own", "_before")).drop("_own", "_before")


def mask_sequence(manifest: DataFrame, analysis: DataFrame, path: str, confidence: str, placeholder: Column, frame_path: str, keep: Sequence[str]) -> DataFrame:
    """Usable masks of a manifest with the analysis row of the same file stem. Rows without a path or confidence are
    dropped; placeholder masks stay as refused rows."""
    m = manifest.where(F.col(path).isNotNull() & (F.length(path) > 0) & (F.col(confidence) > 0)).withColumn("refused", placeholder).withColumn("stem", stem(F.col(path)))
    a = analysis.select(stem(F.col(frame_path)).alias("stem"), *keep)
    return join_same(m, a, ["stem"], "left")


def list_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Masks found in a folder: path, size and content hash, without keeping the pixels."""
    d = spark.read.format("binaryFile").load(folder)
    return d.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.lit(1.0).alias("confidence"))


def sparse_points(models: DataFrame, clip: str) -> DataFrame:
    """Point rows of nested sparse models (``points`` array of id, xyz, track, error)."""
    p = F.col("p")
    return models.select(clip, F.explode("points").alias("p")).select(clip, p["id"].alias("point_id"), p["xyz"][0].alias("x"), p["xyz"][1].alias("y"), p["xyz"][2].alias("z"), F.size(p["track"]).alias("track_length"), p["error"].alias("error"))


def sparse_observations(models: DataFrame, clip: str) -> DataFrame:
    """Observation rows of nested sparse models: one per point and track element (view, u, v)."""
    d = models.select(clip, F.explode("points").alias("p")).select(clip, F.col("p.id").alias("point_id"), F.explode("p.track").alias("t"))
    return d.select(clip, "point_id", "t.view", "t.u", "t.v")


def sparse_views(models: DataFrame, clip: str) -> DataFrame:
    """Pose rows of nested sparse models with the clip's shared camera."""
    return models.select(clip, "camera", F.explode("images").alias("i")).select(clip, F.col("i.name").alias("view"), "i.rotation", "i.translation", "camera.*")


def read_sfm(spark: SparkSession, path: str, clip: str = "clip_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Views, points and observations of a Parquet folder of nested sparse models."""
    m = spark.read.parquet(path)
    return sparse_views(m, clip), sparse_points(m, clip), sparse_observations(m, clip)


def fan(polygons: DataFrame, ids: str) -> DataFrame:
    """Triangles (first, k, k+1) of each row's polygon as rows with their ``part`` number; fewer than three corners
    give none."""
    corner = lambda k: F.get(F.col(ids), k).cast("long")
    first = F.when(F.size(ids) >= 3, F.sequence(F.lit(1), F.size(ids) - 2))
    # all corners come from the generator: no filter on them then moves to the polygons, to read the ids of every line
    d = polygons.withColumn("_k", F.explode(F.transform(first, lambda k: F.struct((k - 1).alias("part"), corner(F.lit(0)).alias("v0"), corner(k).alias("v1"), corner(k + 1).alias("v2")))))
    return d.select("*", "_k.*").drop("_k")


def parse_mesh_text(texts: DataFrame, by: Sequence[str], text: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) and triangles (fid, v0, v1, v2) of line-based mesh text.

    Corner tokens ``a/b/c`` keep the first id; negative ids count back from the vertices read so far; polygons are
    fanned. Ids are zero-based. Line numbers keep the order, so relative ids need only a running count.
    """
    by = list(by)
    lines = texts.select(*by, F.posexplode(F.split(text, r"\r?\n")).alias("line", "value"))
    d = by_group(_mesh_lines(lines).where("_k IS NOT NULL"), by, lambda d, g: g.running(d, ["line"], _seen=(F.col("_k") == "v").cast("long")))
    d = settle(d)  # read once, for vertices and faces and however often they are joined
    return _vertices(d, by), _faces(d, by)


def _mesh_lines(lines: DataFrame) -> DataFrame:
    """Of vertex lines (``_k``: v) the numbers ``_x``, ``_y`` and ``_z``, of face lines (f) the ids of the corners as they stand."""
    d = lines.withColumn("_t", F.split(F.trim("value"), r"\s+")).withColumn("_k", F.get("_t", F.lit(0)))
    at = lambda i: F.when(F.col("_k") == "v", F.get("_t", F.lit(i)).try_cast("double"))
    raw = F.transform(F.slice("_t", F.lit(2), F.size("_t") - 1), lambda c: F.substring_index(c, "/", 1).try_cast("long"))
    kind = F.when(F.col("_k").isin("v", "f"), F.col("_k"))
    return d.withColumns({"_x": at(1), "_y": at(2), "_z": at(3), "_raw": F.when(F.col("_k") == "f", raw), "_k": kind}).drop("value", "_t")


def _vertices(d: DataFrame, by: list[str]) -> DataFrame:
    return d.where("_k = 'v'").select(*by, (F.col("_seen") - 1).alias("vid"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_z").alias("z"))


def _faces(d: DataFrame, by: list[str]) -> DataFrame:
    ids = F.transform("_raw", lambda i: F.when(i < 0, F.col("_seen") + i).otherwise(i - 1))
    return fan(d.where("_k = 'f'").select(*by, "line", ids.alias("_ids")), "_ids").select(*by, "line", "part", "v0", "v1", "v2")


def read_mesh_text(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles of mesh text files, keyed by file path, as :func:`parse_mesh_text` gives them. Files are
    read by blocks; the vertices of earlier blocks are added to a block's own, so that relative ids hold across them.

    A task has the lines of its blocks in their order, so it counts them as they pass, and no line is shuffled or sorted:
    of its lines that are vertices or faces, those before a face that are no faces are the vertices it has seen. What its
    earlier blocks and the files' earlier blocks hold comes from one row per block.
    """
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("mesh"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"), "value")
    d = settle(_mesh_lines(d))  # all that follows counts the same lines in the same tasks
    blocks = d.groupBy("mesh", "block").agg(F.min("_at").alias("_first"), F.count("*").alias("_lines"), F.count_if(F.col("_k") == "v").alias("_own"))
    earlier = lambda c, *w: F.coalesce(F.sum(c).over(Window.partitionBy(w[0]).orderBy(w[1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_task", F.shiftright("_first", PART_BITS))
    blocks = blocks.select("mesh", "block", (earlier("_lines", "mesh", "block") - F.col("_first")).alias("_to_line"), (earlier("_own", "mesh", "block") - earlier("_own", "_task", "_first")).alias("_to_seen"))

    def placed(rows: DataFrame, seen: Column) -> DataFrame:
        out = join_same(rows.withColumn("_s", seen), F.broadcast(blocks), ["mesh", "block"])
        return out.withColumns({"line": F.col("_at") + F.col("_to_line"), "_seen": F.col("_s") + F.col("_to_seen")})

    passed = F.monotonically_increasing_id()
    v = placed(d.where("_k = 'v'").withColumn("_i", passed), F.col("_i").bitwiseAND((1 << PART_BITS) - 1) + 1)
    f = placed(d.where("_k IS NOT NULL").withColumn("_i", passed).where("_k = 'f'").withColumn("_j", passed), F.col("_i") - F.col("_j"))
    return _vertices(v, ["mesh"]), _faces(f, ["mesh"])


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Stored predictions with the outcome of the contract checks and of their content hash."""
    from clipledger.operators.lineage import array_hash
    from clipledger.operators.predict import check_predictions

    d = check_predictions(spark.read.parquet(path))
    return d.withColumn("hash_matches", array_hash(F.col("values"), "float32", F.array("h", "w")) == F.col("output_sha256"))
