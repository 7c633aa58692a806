"""Queries of the photo catalogue: scans, grid, facets, thumbnails, eviction, mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import catalogue as ops
from ..operators import ordered
from ..operators.grid import GridFilter, grid, grid_count, grid_ids, page_after
from .registry import query

SHOWN = GridFilter(flags=frozenset({0, 2}), min_rating=2, search="doc 0")


@query("grid", "J1 PF1 PF2 PF3 PF4 PF6 PF7 PF9 SO1 SF2", """
SELECT p.id, p.project, p.display_name, p.rating, p.flag_state, p.color_label, p.captured_at, t.path AS thumb_path,
       CASE WHEN e.photo_id IS NULL OR e.is_neutral = 1 THEN 0 ELSE 1 END AS edited
FROM photos p LEFT JOIN thumbnails t ON t.photo_id = p.id LEFT JOIN edits e ON e.photo_id = p.id
WHERE deleted_at IS NULL AND flag_state IN (0, 2) AND rating >= 2
  AND (lower(display_name) LIKE '%doc%' OR lower(camera_model) LIKE '%doc%' OR lower(lens_model) LIKE '%doc%' OR lower(keywords) LIKE '%doc%')
  AND (lower(display_name) LIKE '%0%' OR lower(camera_model) LIKE '%0%' OR lower(lens_model) LIKE '%0%' OR lower(keywords) LIKE '%0%')
ORDER BY coalesce(captured_at, added_at) DESC, id DESC""")
def _(v):
    return grid(v.photos, v.thumbnails, v.edits, SHOWN).select("id", "project", "display_name", "rating", "flag_state", "color_label", "captured_at", "thumb_path", "edited")


@query("grid_ids", "SO3 O3 SRC2", "SELECT id FROM photos WHERE deleted_at IS NULL AND project = 'src3' AND color_label = 3 ORDER BY lower(display_name), id")
def _(v):
    return grid_ids(v.photos, GridFilter(project="src3", color=3), "name", False)


@query("grid_count", "AG1 O2", "SELECT count(*) AS n FROM photos WHERE deleted_at IS NOT NULL AND rating >= 3")
def _(v):
    return grid_count(v.photos, GridFilter(trash=True, min_rating=3))


@query("grid_page", "SO4", "SELECT id, added_at FROM photos WHERE deleted_at IS NULL AND (added_at < 1700000500000) ORDER BY added_at DESC, id DESC LIMIT 50")
def _(v):
    return page_after(v.photos, GridFilter(), 1700000500000, 0, 50).select("id", "added_at")


@query("grid_mask", "PF8", "SELECT id, cast((flag_state + 1) + (rating << 3) + (color_label << 6) AS BIGINT) AS mask, cast(((flag_state + 1) & 7) AS BIGINT) AS flags, cast(least(rating, 5) AS BIGINT) AS rating, cast(color_label AS BIGINT) AS color FROM photos")
def _(v):
    mask = scalar.pack_mask(F.col("flag_state") + 1, F.col("rating"), F.col("color_label"))
    return v.photos.select("id", mask.alias("mask")).select("id", "mask", *scalar.unpack_mask(F.col("mask")))


@query("project_rows", "SRC1", "SELECT id, display_name, size_bytes FROM photos WHERE project = 'src1'")
def _(v):
    return v.photos.where("project = 'src1'").select("id", "display_name", "size_bytes")


@query("point_lookup", "SRC3", "SELECT id, project, source_uri FROM photos WHERE project = 'src5' AND source_uri = (SELECT min(source_uri) FROM photos WHERE project = 'src5') ORDER BY id LIMIT 1")
def _(v):
    rows = v.photos.where("project = 'src5'")
    low = rows.agg(F.min("source_uri").alias("source_uri"))
    return rows.join(F.broadcast(low), "source_uri").select("id", "project", "source_uri").orderBy("id").limit(1)


@query("by_ids", "SRC4", "SELECT id, display_name FROM photos WHERE id IN (SELECT vec_id FROM embeddings WHERE label = 1)")
def _(v):
    return ops.by_ids(v.photos, v.table("embeddings").where("label = 1").select(F.col("vec_id").alias("id"))).select("id", "display_name")


@query("whole_tag", "PF10", "SELECT id FROM photos WHERE keywords LIKE '%|k3|%'")
def _(v):
    return v.photos.where(F.array_contains(scalar.tags("keywords"), "k3")).select("id")


@query("backfill_candidates", "PF11", "SELECT id FROM photos WHERE camera_make = '' AND camera_model = '' AND iso = 0 ORDER BY id LIMIT 200")
def _(v):
    return v.photos.where("camera_make = '' and camera_model = '' and iso = 0").select("id").orderBy("id").limit(200)


@query("expired_trash", "PF12 MU9", "SELECT id, deleted_at FROM photos WHERE deleted_at IS NOT NULL AND deleted_at < 1703000000000 - 2592000000")
def _(v):
    return ops.expired(v.photos, 1703000000000).select("id", "deleted_at")


@query("optional_scope", "PF5 AG10", "SELECT keywords FROM photos WHERE (CAST(NULL AS VARCHAR) IS NULL OR project = NULL) AND keywords <> '' AND deleted_at IS NULL")
def _(v):
    return ops.keywords_in_scope(v.photos, None)


@query("unedited", "J2", "SELECT p.id FROM photos p LEFT JOIN edits e ON e.photo_id = p.id WHERE e.photo_id IS NULL AND p.deleted_at IS NULL")
def _(v):
    return ops.unedited(v.photos, v.edits).select("id")


@query("cached_projects", "J3 AG3", "SELECT count(DISTINCT p.project) AS n FROM thumbnails t JOIN photos p ON p.id = t.photo_id")
def _(v):
    return v.thumbnails.join(v.photos.select(F.col("id").alias("photo_id"), "project"), "photo_id").agg(F.countDistinct("project").alias("n"))


@query("victims", "J4 AG5 SO7", """
, s AS (SELECT p.project, sum(t.bytes) AS used FROM thumbnails t JOIN photos p ON p.id = t.photo_id GROUP BY p.project)
SELECT t.photo_id, t.bytes, (s.used - 100000)::BIGINT AS over_share FROM thumbnails t JOIN photos p ON p.id = t.photo_id JOIN s ON s.project = p.project ORDER BY over_share DESC, last_accessed_at, photo_id""")
def _(v):
    return ops.victims(v.photos, v.thumbnails, 100_000)


@query("thumb_totals", "AG2", "SELECT coalesce(sum(bytes), 0)::BIGINT AS bytes, coalesce(sum(CASE WHEN bytes > 5000 THEN bytes END), 0)::BIGINT AS large, (SELECT coalesce(sum(bytes), 0) FROM thumbnails WHERE photo_id < 0)::BIGINT AS none FROM thumbnails")
def _(v):
    none = F.coalesce(F.sum(F.when(F.col("photo_id") < 0, F.col("bytes"))), F.lit(0))
    return v.thumbnails.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(F.col("bytes") > 5000, F.col("bytes"))), F.lit(0)).alias("large"), none.alias("none"))


@query("camera_facet", "AG4", "SELECT camera_model AS value, count(*) AS n FROM photos WHERE camera_model <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 12")
def _(v):
    return ops.facet(v.photos, "camera_model")


@query("lens_facet", "AG4", "SELECT lens_model AS value, count(*) AS n FROM photos WHERE lens_model <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 12")
def _(v):
    return ops.facet(v.photos, "lens_model")


@query("keyword_counts", "AG10 SF4", "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(trim(keywords, '|'), '|')) AS tag FROM photos WHERE keywords <> '') GROUP BY tag")
def _(v):
    return v.photos.select(F.explode(scalar.tags("keywords")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("newest", "SO5", "SELECT id, added_at FROM photos WHERE deleted_at IS NULL ORDER BY added_at DESC, id DESC LIMIT 20")
def _(v):
    return v.photos.where("deleted_at is null").orderBy(F.desc("added_at"), F.desc("id")).select("id", "added_at").limit(20)


@query("earliest_by_project", "SO6", "SELECT project, min(id) AS id FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY added_at, id) AS k FROM photos) WHERE k = 1 GROUP BY project")
def _(v):
    return v.photos.groupBy("project").agg(F.min_by("id", F.struct("added_at", "id")).alias("id"))


@query("projects_ordered", "SO8", "SELECT project, count(*) AS n, max(added_at) AS latest FROM photos GROUP BY project ORDER BY latest, project")
def _(v):
    return v.photos.groupBy("project").agg(F.count("*").alias("n"), F.max("added_at").alias("latest")).orderBy("latest", "project")


@query("sorted_nocase", "SO2", "SELECT id, display_name FROM photos WHERE rating = 5 ORDER BY lower(display_name), id")
def _(v):
    return v.photos.where("rating = 5").select("id", "display_name").orderBy(F.collate("display_name", "UTF8_LCASE"), "id")


@query("stack_sizes", "W9", "SELECT id, stack_key, CASE WHEN stack_key = '' THEN 1 ELSE count(*) OVER (PARTITION BY stack_key) END AS stack_count FROM photos WHERE deleted_at IS NULL")
def _(v):
    return ops.with_stack_count(v.photos.where("deleted_at is null")).select("id", "stack_key", "stack_count")


@query("missing_stack_keys", "MU9 SF5", r"SELECT id, left(lower(CASE WHEN regexp_matches(display_name, '^.+\.[^.]*$') THEN regexp_extract(display_name, '^(.+)\.[^.]*$', 1) ELSE display_name END), 120) AS stack_key FROM photos WHERE stack_key = ''")
def _(v):
    return v.photos.where("stack_key = ''").select("id", scalar.stack_key("display_name").alias("stack_key"))


@query("relink", "MU8", "SELECT a.id, b.id AS candidate FROM photos a JOIN photos b ON a.fingerprint = b.fingerprint AND a.id <> b.id WHERE NOT a.uri_ok AND b.uri_ok")
def _(v):
    return ops.relink(v.photos)


@query("duplicate_guard", "MU7 SNK1", ", incoming AS (SELECT project, source_uri, min(id) AS id FROM photos WHERE id % 3 = 0 GROUP BY ALL), held AS (SELECT DISTINCT project, source_uri FROM photos WHERE id % 3 = 1) SELECT i.id, i.project FROM incoming i ANTI JOIN held h ON h.project = i.project AND h.source_uri = i.source_uri")
def _(v):
    incoming = v.photos.where("id % 3 = 0").groupBy("project", "source_uri").agg(F.min("id").alias("id"))
    return ops.new_rows(incoming, v.photos.where("id % 3 = 1"), ["project", "source_uri"]).select("id", "project")


@query("batch_flag", "MU1 MU2 MU3", "SELECT id, CASE WHEN id % 4 = 1 THEN 2 ELSE flag_state END AS flag_state, CASE WHEN id % 4 = 1 THEN 5 ELSE rating END AS rating, CASE WHEN id % 4 = 1 THEN 1704000000000 ELSE deleted_at END AS deleted_at, CASE WHEN id % 4 = 1 THEN 'moved' ELSE project END AS project FROM photos")
def _(v):
    ids = v.photos.where("id % 4 = 1").select("id")
    out = ops.update_by_ids(v.photos, ids, {"flag_state": F.lit(2), "rating": F.lit(5), "deleted_at": F.lit(1704000000000), "project": F.lit("moved")})
    return out.select("id", "flag_state", "rating", "deleted_at", "project")


@query("backfill", "MU4 MU5 SF1", ", m AS (SELECT id, 'Probe' AS camera_make, CASE WHEN id % 2 = 0 THEN 400 ELSE 0 END AS iso, CAST(NULL AS VARCHAR) AS lens_model FROM photos WHERE id % 5 = 0) SELECT p.id, CASE WHEN m.id IS NULL THEN p.camera_make ELSE m.camera_make END AS camera_make, CASE WHEN m.iso > 0 THEN m.iso ELSE p.iso END::INTEGER AS iso, coalesce(m.lens_model, p.lens_model) AS lens_model FROM photos p LEFT JOIN m USING (id)")
def _(v):
    probe = v.photos.where("id % 5 = 0").select("id", F.lit("Probe").alias("camera_make"), F.when(F.col("id") % 2 == 0, 400).otherwise(0).alias("iso"), F.lit(None).cast("string").alias("lens_model"))
    return ops.backfill(v.photos, probe).select("id", "camera_make", "iso", "lens_model")


@query("cascade_delete", "SNK4", ", dead AS (SELECT id FROM photos WHERE project = 'src2') SELECT 'photos' AS t, count(*) AS n FROM photos WHERE project <> 'src2' UNION ALL SELECT 'edits', count(*) FROM edits WHERE photo_id NOT IN (SELECT id FROM dead) UNION ALL SELECT 'thumbnails', count(*) FROM thumbnails WHERE photo_id NOT IN (SELECT id FROM dead)")
def _(v):
    left = ops.delete_project(v.photos, v.edits, v.thumbnails, "src2")
    counts = [d.agg(F.lit(n).alias("t"), F.count("*").alias("n")) for n, d in zip(("photos", "edits", "thumbnails"), left, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("upsert", "SNK2 J9", "SELECT photo_id, revisions FROM (SELECT photo_id, CASE WHEN photo_id % 2 = 0 THEN 99 ELSE revisions END AS revisions FROM edits) UNION ALL SELECT id, 99 FROM photos WHERE id % 2 = 0 AND id NOT IN (SELECT photo_id FROM edits)")
def _(v):
    fresh = v.photos.where("id % 2 = 0").select(F.col("id").alias("photo_id"), F.lit(99).alias("revisions"))
    return ops.upsert(v.edits.select("photo_id", "revisions"), fresh, ["photo_id"])


@query("delete_by_key", "SNK3", "SELECT photo_id, path FROM thumbnails WHERE photo_id NOT IN (SELECT doc_id FROM labels)")
def _(v):
    return ops.delete_by_key(v.thumbnails, v.edits.select("photo_id"), ["photo_id"]).select("photo_id", "path")


@query("migrations", "MU6", "SELECT id, project, '' AS keywords, CAST(NULL AS BIGINT) AS deleted_at, '' AS stack_key, 0 AS iso FROM photos")
def _(v):
    return ops.migrate(v.photos.select("id", "project"), 1).select("id", "project", "keywords", "deleted_at", "stack_key", "iso")


@query("mru", "KN13 ST3", "SELECT id, CASE WHEN id % 3 = 0 THEN list_filter([format, 'a', 'b', 'c'], lambda x: x <> 'b') ELSE list_prepend('z', list_slice([format, 'a', 'b', 'c'], 1, 29)) END AS mru, CASE WHEN id % 2 = 0 THEN [1, 3] ELSE [1, 2, 3, 4] END AS toggled FROM photos")
def _(v):
    held = F.array("format", F.lit("a"), F.lit("b"), F.lit("c"))
    mru = F.when(F.col("id") % 3 == 0, scalar.toggle(held, F.lit("b"))).otherwise(scalar.move_to_front(held, F.lit("z"), 30))
    toggled = F.when(F.col("id") % 2 == 0, scalar.toggle(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(2))).otherwise(scalar.toggle(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(4)))
    return v.photos.select("id", mru.alias("mru"), toggled.alias("toggled"))


@query("tag_edit", "ST4 SF3", "SELECT id, CASE WHEN keywords = '' THEN '|new|' ELSE '|' || array_to_string(list_sort(list_distinct(list_append(string_split(trim(keywords, '|'), '|'), 'new'))), '|') || '|' END AS added, CASE WHEN keywords = '' OR format IS NULL THEN '' ELSE '|' || array_to_string(list_sort(list_filter(string_split(trim(keywords, '|'), '|'), lambda x: x <> 'en')), '|') || '|' END AS removed FROM photos")
def _(v):
    return v.photos.select("id", scalar.add_tag("keywords", F.lit("  New ")).alias("added"), scalar.remove_tag("keywords", F.lit("EN")).alias("removed"))


@query("nested_any", "PF19 PF20 PF21", "SELECT id, format = 'en' OR iso > 500 AS any_hit, CASE WHEN iso > 150 THEN iso WHEN rating > 150 THEN rating END AS first_hit, list_filter([iso, rating, 7], lambda x: x <> 7) AS others, [iso, 0, 7] AS replaced FROM photos")
def _(v):
    nested = F.array("iso", "rating", F.lit(7))
    return v.photos.select(
        "id", ((F.col("format") == "en") | F.exists(nested, lambda x: x > 500)).alias("any_hit"), F.try_element_at(F.filter(nested, lambda x: x > 150), F.lit(1)).alias("first_hit"),
        F.filter(nested, lambda x: x != 7).alias("others"), F.transform(nested, lambda x, i: F.when(i == 1, 0).otherwise(x)).alias("replaced"),
    )


@query("batch_status", "AG28", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN uri_ok AND rating > 0 THEN 'success' WHEN uri_ok THEN 'skipped' ELSE 'failure' END AS status FROM photos) GROUP BY status")
def _(v):
    status = F.when(F.col("uri_ok") & (F.col("rating") > 0), "success").when(F.col("uri_ok"), "skipped").otherwise("failure")
    return v.photos.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("fold_actions", "AG29 UX2", "SELECT id, CASE WHEN rating > 2 THEN rating * 10 ELSE iso END::INTEGER AS exposure FROM photos")
def _(v):
    stack = F.array(F.struct(F.lit(True).alias("on"), F.col("iso").alias("v")), F.struct((F.col("rating") > 2).alias("on"), (F.col("rating") * 10).alias("v")))
    return v.photos.select("id", F.aggregate(stack, F.lit(0), lambda a, x: F.when(x["on"], x["v"]).otherwise(a)).alias("exposure"))


@query("neighbours", "W7 W8", "SELECT id, coalesce(lag(id) OVER w, max(id) OVER (PARTITION BY project)) AS left_id, coalesce(lead(id) OVER w, min(id) OVER (PARTITION BY project)) AS right_id, coalesce(lag(id) OVER w, lead(id) OVER w) AS nearest FROM photos WINDOW w AS (PARTITION BY project ORDER BY id)")
def _(v):
    near = ordered.beside(v.photos.select("project", "id"), ["project"], [F.col("id")], "id")
    ends = v.photos.groupBy("project").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    near = near.join(ends.withColumnRenamed("project", "of"), F.col("project").eqNullSafe(F.col("of")))
    return near.select("id", F.coalesce("before", "high").alias("left_id"), F.coalesce("after", "low").alias("right_id"), F.coalesce("before", "after").alias("nearest"))


@query("chunks", "W11", "SELECT project, chunk, min(size_bytes) AS low, max(size_bytes) AS high FROM (SELECT project, size_bytes, (row_number() OVER (PARTITION BY project ORDER BY id) - 1) // 2 AS chunk FROM photos) GROUP BY ALL")
def _(v):
    placed = ordered.positions(v.photos.select("project", "id", "size_bytes"), ["project"], [F.col("id")])
    return placed.withColumn("chunk", F.floor((F.col("pos") - 1) / 2)).groupBy("project", "chunk").agg(F.min("size_bytes").alias("low"), F.max("size_bytes").alias("high"))
