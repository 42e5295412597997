"""Strings, n-grams, images, geometry, styles, samples, crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismatch.functions import geometry as Geo
from prismatch.functions import text as X
from prismatch.functions import vectors as V
from prismatch.operators import crops as Crops
from prismatch.operators import features as Feat
from prismatch.operators import pixels as Pix
from prismatch.operators import sampling as Samp
from prismatch.operators import styles as Style
from prismatch.plans import views
from prismatch.plans.registry import query
from prismatch.plans.views import table
from prismatch.session import stage

SS = "WITH " + views.SS_SQL


def _r(c, n=6):
    return F.round(c, n)


# ---- strings --------------------------------------------------------------
@query("rle_segments", SS + """, r AS (SELECT unnest(regexp_extract_all(ss_string, '(H+|E+|-+)')) AS run FROM ss)
SELECT run[1] AS symbol, len(run) AS length, count(*) AS n FROM r GROUP BY 1, 2""")
def rle_segments(spark, sf):
    s = views.ss(spark, sf).select(F.explode_outer(X.runs("ss_string")).alias("run")).where("run is not null")
    return s.groupBy(F.substring("run", 1, 1).alias("symbol"), F.length("run").cast("bigint").alias("length")).agg(F.count("*").alias("n"))


_ELEMENTS = SS + """, el AS (SELECT *, regexp_extract_all(ss_string, '(H{4,}|E{2,})') AS runs, len(ss_string) AS n FROM ss),
su AS (SELECT domain_id, n AS n_res, array_to_string(list_transform(runs, lambda x: x[1]), '') AS element_string,
  (n - len(replace(ss_string, 'H', ''))) / n::DOUBLE AS frac_H, (n - len(replace(ss_string, 'E', ''))) / n::DOUBLE AS frac_E, (n - len(replace(ss_string, '-', ''))) / n::DOUBLE AS frac_C,
  list_transform(list_filter(runs, lambda x: x[1] = 'H'), lambda x: len(x)) AS hel, list_transform(list_filter(runs, lambda x: x[1] = 'E'), lambda x: len(x)) AS str FROM el),
summary AS (SELECT domain_id, n_res, element_string, frac_H, frac_E, frac_C, len(hel) AS n_helix, len(str) AS n_strand,
  CASE WHEN len(hel) > 0 THEN list_sum(hel) / len(hel)::DOUBLE ELSE 0 END AS mean_helix_len, CASE WHEN len(str) > 0 THEN list_sum(str) / len(str)::DOUBLE ELSE 0 END AS mean_strand_len,
  coalesce(list_max(hel), 0) AS max_helix_len, coalesce(list_max(str), 0) AS max_strand_len FROM su)"""


def _summary(spark, sf):
    return X.with_ss_summary(views.ss(spark, sf).select("domain_id", "source", "ss_string"), "ss_string").drop("ss_string")


@query("ss_summary", _ELEMENTS + """ SELECT domain_id, n_res, element_string, round(frac_H, 6) AS frac_H, round(frac_E, 6) AS frac_E, round(frac_C, 6) AS frac_C,
 n_helix, n_strand, round(mean_helix_len, 6) AS mean_helix_len, round(mean_strand_len, 6) AS mean_strand_len, max_helix_len, max_strand_len, true AS ok FROM summary""")
def ss_summary(spark, sf):
    s = _summary(spark, sf).drop("source")
    for c in ("frac_H", "frac_E", "frac_C", "mean_helix_len", "mean_strand_len"):
        s = s.withColumn(c, _r(c))
    return s


@query("numeric_features", _ELEMENTS + """ SELECT domain_id, round(100.0::DOUBLE * n_helix / n_res, 5) AS helix_per_100, round(100.0::DOUBLE * n_strand / n_res, 5) AS strand_per_100,
 round(frac_H / (frac_E + 1e-3), 5) AS he_ratio, round(ln(1 + n_res::DOUBLE), 5) AS log_n_res, 14 AS width FROM summary""")
def numeric_features(spark, sf):
    s = _summary(spark, sf).select("domain_id", Feat.numeric_block().alias("x"))
    names = ("helix_per_100", "strand_per_100", "he_ratio", "log_n_res")
    return s.select("domain_id", *[_r(F.element_at("x", 11 + i), 5).alias(n) for i, n in enumerate(names)], F.size("x").alias("width"))


@query("length_features", SS + " SELECT domain_id, len(ss_string)::DOUBLE AS n, round(ln(1 + len(ss_string)::DOUBLE), 6) AS log_n FROM ss")
def length_features(spark, sf):
    s = views.ss(spark, sf).select("domain_id", F.length("ss_string").alias("n_res")).select("domain_id", Feat.length_block().alias("x"))
    return s.select("domain_id", F.col("x")[0].alias("n"), _r(F.col("x")[1]).alias("log_n"))


_GRAMS = """, g AS (SELECT domain_id, substring(element_string, i, k) AS term FROM
  (SELECT domain_id, element_string, k, unnest(range(1, len(element_string) - k + 2)) AS i FROM (SELECT domain_id, element_string, unnest(range(1, 6)) AS k FROM summary))),
tf AS (SELECT domain_id, term, count(*) AS tf FROM g GROUP BY 1, 2)"""


@query("char_ngrams", _ELEMENTS + _GRAMS + " SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS n_docs FROM tf GROUP BY 1")
def char_ngrams(spark, sf):
    t = Feat.term_counts(_summary(spark, sf), "domain_id", "element_string")
    return t.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("n_docs"))


@query("tfidf", _ELEMENTS + _GRAMS + """, tr AS (SELECT doc_id FROM documents WHERE CAST(substring(source, 4) AS INTEGER) < 14),
v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS index, ln((1 + (SELECT count(*) FROM tr)) / (1 + count(*))::DOUBLE) + 1 AS idf
      FROM tf JOIN tr ON domain_id = doc_id GROUP BY 1 HAVING count(*) >= 2),
w AS (SELECT domain_id, index, term, tf * idf AS w FROM tf JOIN v USING (term))
SELECT domain_id, index, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY domain_id)), 6) AS weight FROM w""")
def tfidf(spark, sf):
    """Fitted on the training sources, applied to every document."""
    s = stage(_summary(spark, sf).select("domain_id", "source", "element_string"), "elements")
    train = s.where(F.substring("source", 4, 10).cast("int") < 14)
    vocabulary = stage(Feat.fit_tfidf(train, "domain_id", "element_string"), "vocabulary")
    return Feat.transform_tfidf(s, vocabulary, "domain_id", "element_string").withColumn("weight", _r("weight"))


@query("sign_log", "SELECT event_id, round(sign(value - 50) * ln(1 + abs(value - 50)), 6) AS x FROM events")
def sign_log(spark, sf):
    return table(spark, sf, "events").select("event_id", _r(V.sign_log(F.col("value") - 50)).alias("x"))


@query("style_lines", """SELECT p_partkey, concat_ws(' ', p_type, p_brand, 'bg=' || p_name, 'rtm=' || p_size % 2, 'aa=' || p_size % 3, 'ao=' || p_size % 2,
 CASE WHEN p_size > 25 THEN 'ligand' END, CASE WHEN p_size % 5 > 0 THEN 'transp=' || printf('%.2f', p_size % 5 / 10.0::DOUBLE) END, CASE WHEN p_size % 2 = 1 THEN 'ortho' END,
 CASE WHEN p_size % 7 = 0 THEN 'cylhel' END, CASE WHEN p_size % 4 = 0 THEN 'nonflat' END) AS line FROM part""")
def style_lines(spark, sf):
    z = F.col("p_size")
    style = {
        "cartoon_style": F.col("p_type"), "color_scheme": F.col("p_brand"), "background": F.col("p_name"), "ray_trace_mode": z % 2, "antialias": z % 3,
        "ambient_occlusion": z % 2, "content": F.when(z > 25, "ligand").otherwise("cartoon_only"), "cartoon_transparency": z % 5 / 10.0,
        "orthoscopic": z % 2, "cylindrical_helices": F.when(z % 7 == 0, 1).otherwise(0), "fancy_helices": F.lit(0),
        "flat_sheets": F.when(z % 4 == 0, 0).otherwise(1), "depth_cue": F.lit(0)}
    return table(spark, sf, "part").select("p_partkey", X.style_description(style).alias("line"))


@query("wrap_two_lines")
def wrap_two_lines(spark, sf):
    """Greedy two-line titles of whole documents (a sequential fold per row)."""
    w = X.wrap_two_lines("text", 40)
    return table(spark, sf, "benchmark").select("item_id", w.alias("w")).select("item_id", "w.line1", "w.line2")


@query("csv_escape", """SELECT doc_id, CASE WHEN text[1] IN ('=', '+', '-', '@') THEN '''' || text ELSE text END AS safe FROM documents""")
def csv_escape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.csv_safe("text").alias("safe"))


@query("id_lists", r"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(trim(url), '[;\s,/]+'), lambda x: upper(x)), lambda x: x <> ''), '|') AS parts,
 regexp_matches(upper(substring(url, 8, 4)), '^[0-9][A-Z0-9]{3}$') AS looks_like_id FROM pages""")
def id_lists(spark, sf):
    p = table(spark, sf, "pages")
    # addresses hold slashes where id lists hold semicolons
    return p.select("page_id", F.array_join(X.split_ids(F.translate("url", "/", ";")), "|").alias("parts"), X.is_entry_id(F.upper(F.substring("url", 8, 4))).alias("looks_like_id"))


@query("content_fingerprint", "SELECT doc_id, sha256(text) AS sha256, substring(sha256(text), 1, 16) AS fingerprint FROM documents")
def content_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), X.fingerprint("text").alias("fingerprint"))


@query("sha_panel_digest")
def sha_panel_digest(spark, sf):
    """Digest of the validation panel of 5 seeded entries."""
    panel = Samp.validation_panel(views.manifest(spark, sf), 5, 9)
    n = panel.agg(F.count("*").alias("n_rows"))
    return n.withColumn("digest", F.lit(Samp.panel_digest(panel)))


@query("validation_panel")
def validation_panel(spark, sf):
    return Samp.validation_panel(views.manifest(spark, sf), 5, 9).select("render_id", "entry", "view")


@query("pk_batches", "WITH " + views.MANIFEST_SQL + """, sizes AS (SELECT entry, count(*) AS n FROM manifest WHERE split = 'train' GROUP BY entry)
SELECT step, least(16, (SELECT count(*) FROM sizes)) AS entries, least(16, (SELECT count(*) FROM sizes)) AS train_entries, 0 AS wrong_size, 0 AS repeated_views
FROM range(50) AS t(step)""")
def pk_batches(spark, sf):
    """What must hold for every step: 16 different train entries, 4 rows of each (or as many as it has), no view twice where it has 4."""
    m = views.manifest(spark, sf).where("split = 'train'")
    sizes = m.groupBy("entry").agg(F.count(F.lit(1)).alias("n"))
    per = Samp.pk_batches(m, p=16, k=4, steps=50, seed=12).groupBy("step", "entry").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("render_id").alias("views"))
    known = per.join(sizes, "entry", "left")
    return known.groupBy("step").agg(
        F.count_distinct("entry").cast("int").alias("entries"), F.count("n").cast("int").alias("train_entries"),
        F.count_if(F.col("rows") != F.least(F.lit(4), F.col("n"))).cast("int").alias("wrong_size"),
        F.count_if((F.col("n") >= 4) & (F.col("views") < 4)).cast("int").alias("repeated_views"))


@query("crc_seed")
def crc_seed(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return li.select("l_orderkey", "l_linenumber", X.view_seed("l_orderkey", "l_linenumber", 0).alias("seed"))


@query("style_sampling")
def style_sampling(spark, sf):
    """Styles of every attempted view."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("object_id"), (F.col("l_linenumber") - 1).alias("view")).distinct()
    return Style.sample_styles(li)


# ---- geometry -------------------------------------------------------------
@query("rotation_matrix", """WITH q AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings),
n AS (SELECT vec_id, a / r AS w, b / r AS x, c / r AS y, d / r AS z FROM (SELECT *, sqrt(a*a + b*b + c*c + d*d) AS r FROM q))
SELECT vec_id, round(1 - 2 * (y*y + z*z), 6) AS m0, round(2 * (x*y - z*w), 6) AS m1, round(2 * (x*z + y*w), 6) AS m2, round(2 * (x*y + z*w), 6) AS m3, round(1 - 2 * (x*x + z*z), 6) AS m4,
 round(2 * (y*z - x*w), 6) AS m5, round(2 * (x*z - y*w), 6) AS m6, round(2 * (y*z + x*w), 6) AS m7, round(1 - 2 * (x*x + y*y), 6) AS m8 FROM n""")
def rotation_matrix(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("wxyz")])
    return e.select("vec_id", Geo.rotation_matrix("w", "x", "y", "z").alias("m")).select("vec_id", *[_r(F.col("m")[i]).alias(f"m{i}") for i in range(9)])


@query("hue_colours", """WITH h AS (SELECT p_partkey, (p_partkey % 360) / 360.0::DOUBLE AS h, 0.55::DOUBLE AS s, 0.85::DOUBLE AS v FROM part),
k AS (SELECT *, floor(h * 6) AS i, h * 6 - floor(h * 6) AS f FROM h), c AS (SELECT *, v * (1 - s) AS p, v * (1 - s * f) AS q, v * (1 - s * (1 - f)) AS t FROM k)
SELECT p_partkey, round(CASE CAST(i AS INT) % 6 WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END, 6) AS r,
 round(CASE CAST(i AS INT) % 6 WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END, 6) AS g,
 round(CASE CAST(i AS INT) % 6 WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END, 6) AS b FROM c""")
def hue_colours(spark, sf):
    c = Geo.hsv_to_rgb((F.col("p_partkey") % 360) / 360.0, F.lit(0.55), F.lit(0.85))
    return table(spark, sf, "part").select("p_partkey", c.alias("c")).select("p_partkey", *[_r(F.col("c")[i]).alias(n) for i, n in enumerate("rgb")])


@query("camera_shift", "SELECT p_partkey, round((p_size - 25) / 250.0::DOUBLE * 2 * abs(-p_retailprice) * tan(radians(14.0::DOUBLE + p_size % 21) / 2), 5) AS shift FROM part")
def camera_shift(spark, sf):
    z = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", _r(Geo.camera_shift((z - 25) / 250.0, -F.col("p_retailprice"), 14.0 + z % 21), 5).alias("shift"))


_BOX = """WITH b AS (SELECT p_partkey, p_size * 40 + 7 AS w, CAST(p_partkey % 1500 + 1 AS INTEGER) AS h,
  [p_size * 3, CAST(p_partkey % 300 AS INTEGER), p_size * 3 + 500, CAST(p_partkey % 300 AS INTEGER) + 600] AS box FROM part)"""


def _boxes(spark, sf):
    z, k = F.col("p_size"), (F.col("p_partkey") % 300).cast("int")
    return table(spark, sf, "part").select(
        "p_partkey", (z * 40 + 7).alias("w"), (F.col("p_partkey") % 1500 + 1).cast("int").alias("h"), F.array(z * 3, k, z * 3 + 500, k + 600).alias("box"))


@query("canvas_fit", _BOX + """, f AS (SELECT *, 464.0::DOUBLE / greatest(w, h) AS s FROM b), r AS (SELECT *, greatest(1, CAST(round_even(w * s, 0) AS INTEGER)) AS rw, greatest(1, CAST(round_even(h * s, 0) AS INTEGER)) AS rh FROM f)
SELECT p_partkey, rw AS width, rh AS height, (512 - rw) // 2 AS left_pad, (512 - rh) // 2 AS top_pad, s > 1 AS upscaled FROM r""")
def canvas_fit(spark, sf):
    f = _boxes(spark, sf).select("p_partkey", Geo.fit_canvas("w", "h").alias("f"))
    return f.select("p_partkey", "f.width", "f.height", F.col("f.left").alias("left_pad"), F.col("f.top").alias("top_pad"), "f.upscaled")


@query("box_pixels", _BOX + """, p AS (SELECT p_partkey, w, h, CAST(floor(box[1] * w / 1000) AS BIGINT) AS x0, CAST(floor(box[2] * h / 1000) AS BIGINT) AS y0,
 CAST(ceil(box[3] * w / 1000) AS BIGINT) AS x1, CAST(ceil(box[4] * h / 1000) AS BIGINT) AS y1 FROM b)
SELECT p_partkey, x0, y0, x1, y1, 0 <= x0 AND x0 < x1 AND x1 <= w AND 0 <= y0 AND y0 < y1 AND y1 <= h AS inside FROM p""")
def box_pixels(spark, sf):
    b = _boxes(spark, sf).withColumn("px", Geo.box_to_pixels("box", "w", "h"))
    return b.select("p_partkey", *[F.col("px")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], Geo.box_inside("px", "w", "h").alias("inside"))


# ---- images ---------------------------------------------------------------
def _per_image(fn, name):
    def run(spark, sf):
        return views.images(spark, sf).select("image", Pix.per_stack(fn)("rgb", "height", "width").alias(name))

    return run


@query("colour_histogram", "WITH " + views.PIXELS_SQL + " SELECT image, r // 32 * 64 + g // 32 * 8 + b // 32 AS bin, round(count(*) / 64.0::DOUBLE, 6) AS share FROM pixels GROUP BY 1, 2")
def colour_histogram(spark, sf):
    h = _per_image(Pix.colour_histogram, "h")(spark, sf)
    return h.select("image", F.posexplode("h").alias("bin", "share")).where("share > 0").withColumn("bin", F.col("bin").cast("bigint")).withColumn("share", _r("share"))


@query("ink_fraction", "WITH " + views.PIXELS_SQL + ", c AS (SELECT image, r, g, b, count(*) AS n FROM pixels GROUP BY ALL) SELECT image, round(1 - max(n) / sum(n), 6) AS ink FROM c GROUP BY 1")
def ink_fraction(spark, sf):
    return _per_image(Pix.ink_fraction, "x")(spark, sf).select("image", _r(F.col("x")[0]).alias("ink"))


@query("foreground_colour", "WITH " + views.PIXELS_SQL + """, c AS (SELECT image, r, g, b, count(*) AS n FROM pixels GROUP BY ALL),
bg AS (SELECT image, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY n DESC, r, g, b) AS k FROM c) WHERE k = 1),
fg AS (SELECT p.image, p.r / 255.0::DOUBLE AS r, p.g / 255.0::DOUBLE AS g, p.b / 255.0::DOUBLE AS b, greatest(p.r, p.g, p.b) / 255.0::DOUBLE AS hi, least(p.r, p.g, p.b) / 255.0::DOUBLE AS lo
  FROM pixels p JOIN bg USING (image) WHERE abs(p.r - bg.r) + abs(p.g - bg.g) + abs(p.b - bg.b) > 30)
SELECT image, round(avg(r), 5) AS mean_r, round(stddev_pop(g), 5) AS std_g, round(avg(CASE WHEN hi > 0 THEN (hi - lo) / greatest(hi, 1e-6) ELSE 0 END), 5) AS mean_sat,
 round(avg(hi), 5) AS mean_hi, round(avg(lo), 5) AS mean_lo FROM fg GROUP BY 1""")
def foreground_colour(spark, sf):
    x = _per_image(lambda a: Pix.colour_features(a, Pix.modal_mask(a)), "x")(spark, sf)
    at = {"mean_r": 0, "std_g": 4, "mean_sat": 6, "mean_hi": 8, "mean_lo": 9}
    return x.select("image", *[_r(F.col("x")[i], 5).alias(n) for n, i in at.items()])


@query("silhouette_features")
def silhouette_features(spark, sf):
    return _per_image(Pix.silhouette, "features")(spark, sf)


_SILHOUETTE = "WITH " + views.PIXELS_SQL + """, u AS (SELECT image, y, x, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM pixels),
ring AS (SELECT image, median(r) AS r, median(g) AS g, median(b) AS b FROM (SELECT * FROM u WHERE y IN (0, 7) UNION ALL SELECT * FROM u WHERE x IN (0, 7)) GROUP BY 1),
m AS (SELECT u.image, u.y, u.x, sqrt((u.r - ring.r) ** 2 + (u.g - ring.g) ** 2 + (u.b - ring.b) ** 2) > 0.12::DOUBLE AS hit, (u.r + u.g + u.b) / 3 AS grey FROM u JOIN ring USING (image)),
s AS (SELECT image, count(*) AS area, max(y) - min(y) + 1 AS bh, max(x) - min(x) + 1 AS bw, avg(y) AS cy, avg(x) AS cx, stddev_pop(y) AS sy, stddev_pop(x) AS sx FROM m WHERE hit GROUP BY 1),
e AS (SELECT a.image, avg(abs(b.grey - a.grey)) FILTER (b.y = a.y) AS gx, avg(abs(b.grey - a.grey)) FILTER (b.x = a.x) AS gy
  FROM m a JOIN m b ON a.image = b.image AND ((b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1)) GROUP BY 1),
t AS (SELECT image, avg(grey) AS mean, stddev_pop(grey) AS dev FROM m GROUP BY 1)"""


@query("silhouette_moments", _SILHOUETTE + """
SELECT image, round(coalesce(area, 0) / 64.0::DOUBLE, 4) AS area, round(coalesce(CASE WHEN area > 4 THEN bh / 8.0::DOUBLE END, 0), 4) AS height, round(coalesce(CASE WHEN area > 4 THEN bw / 8.0::DOUBLE END, 0), 4) AS width,
 round(coalesce(CASE WHEN area > 4 THEN area / (bh * bw) END, 0), 4) AS fill, round(coalesce(CASE WHEN area > 4 THEN cy / 8 END, 0), 4) AS cy, round(coalesce(CASE WHEN area > 4 THEN cx / 8 END, 0), 4) AS cx,
 round(coalesce(CASE WHEN area > 4 THEN sy / 8 END, 0), 4) AS sy, round(coalesce(CASE WHEN area > 4 THEN sx / 8 END, 0), 4) AS sx,
 round(gx, 4) AS gx, round(gy, 4) AS gy, round(mean, 4) AS mean, round(dev, 4) AS dev FROM t JOIN e USING (image) LEFT JOIN s USING (image)""")
def silhouette_moments(spark, sf):
    """Geometry, edges and brightness of the silhouette, by name."""
    x = _per_image(Pix.silhouette, "f")(spark, sf)
    at = {"area": 0, "height": 1, "width": 2, "fill": 4, "cy": 5, "cx": 6, "sy": 7, "sx": 8, "gx": 9, "gy": 10, "mean": 11, "dev": 12}
    return x.select("image", *[_r(F.col("f")[i], 4).alias(n) for n, i in at.items()])


@query("nuisance_shape", "WITH " + views.PIXELS_SQL + """, c AS (SELECT image, r, g, b, count(*) AS n FROM pixels GROUP BY ALL),
bg AS (SELECT image, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY n DESC, r, g, b) AS k FROM c) WHERE k = 1),
f AS (SELECT p.image, p.y, p.x FROM pixels p JOIN bg USING (image) WHERE abs(p.r - bg.r) + abs(p.g - bg.g) + abs(p.b - bg.b) > 30),
o AS (SELECT f.image, count(*) AS edge FROM f WHERE (SELECT count(*) FROM f n WHERE n.image = f.image AND abs(n.y - f.y) + abs(n.x - f.x) = 1) < 4 - (f.y IN (0, 7))::INT - (f.x IN (0, 7))::INT GROUP BY 1),
s AS (SELECT image, count(*) AS a, max(y) - min(y) + 1 AS bh, max(x) - min(x) + 1 AS bw, avg(y) AS cy, avg(x) AS cx, var_samp(y) AS yy, var_samp(x) AS xx, covar_samp(y, x) AS yx FROM f GROUP BY 1),
e AS (SELECT *, greatest((yy + xx) / 2 + sqrt(((yy - xx) / 2) ** 2 + yx ** 2), 1e-6) AS major, greatest((yy + xx) / 2 - sqrt(((yy - xx) / 2) ** 2 + yx ** 2), 1e-6) AS minor FROM s),
d AS (SELECT image, sqrt((y - cy) ** 2 + (x - cx) ** 2) AS r FROM f JOIN s USING (image)), q AS (SELECT image, avg(r) AS mean, stddev_pop(r) AS dev, max(r) AS reach FROM d GROUP BY 1)
SELECT image, round(a / 64.0::DOUBLE, 4) AS area, round(bw / bh, 4) AS aspect, round(a / (bh * bw), 4) AS fill, round(coalesce(edge, 0) / a, 4) AS rough, round(sqrt(major / minor), 4) AS elongation,
 round(sqrt(major) / 8, 4) AS major, round(mean / reach, 4) AS mean_radius, round(dev / reach, 4) AS dev_radius FROM e JOIN q USING (image) LEFT JOIN o USING (image)""")
def nuisance_shape(spark, sf):
    """Silhouette numbers of the nuisance vector that pixel rows can express, by name."""
    x = _per_image(lambda a: Pix.shape_features(Pix.modal_mask(a)), "f")(spark, sf)
    at = {"area": 0, "aspect": 1, "fill": 2, "rough": 3, "elongation": 5, "major": 6, "mean_radius": 8, "dev_radius": 9}
    return x.select("image", *[_r(F.col("f")[i], 4).alias(n) for n, i in at.items()]).where("area > 0")


@query("hog_features")
def hog_features(spark, sf):
    return _per_image(Pix.hog_features(cell=2), "features")(spark, sf)


@query("nuisance_features")
def nuisance_features(spark, sf):
    """Shape, gradient and colour groups in the fixed order."""
    return _per_image(Pix.nuisance(cell=2), "features")(spark, sf)


@query("combined_nuisance")
def combined_nuisance(spark, sf):
    """Silhouette standardised on the gallery views, followed by the weighted colour histogram."""
    i = views.images(spark, sf).withColumn("view", F.col("image") % 16)
    rows = i.select("image", "view", Pix.per_stack(Pix.silhouette)("rgb", "height", "width").alias("sil"),
                    Pix.per_stack(Pix.colour_histogram)("rgb", "height", "width").alias("col"))
    fit = V.fit_standardiser(rows.where("view between 1 and 15"), "sil")
    return V.standardise(rows, "sil", fit).select("image", Pix.combined_nuisance(F.col("sil"), F.col("col")).alias("features"))


@query("pixel_normalise", "WITH " + views.PIXELS_SQL + """ SELECT image, round(sum((r / 255.0::DOUBLE - 0.485) / 0.229 + (g / 255.0::DOUBLE - 0.456) / 0.224 + (b / 255.0::DOUBLE - 0.406) / 0.225), 4) AS total FROM pixels GROUP BY 1""")
def pixel_normalise(spark, sf):
    # fixed values: channel means and deviations of the encoder's input
    mean, std = [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]
    values = Pix.per_stack(lambda stack: stack.reshape(len(stack), -1))("rgb", "height", "width")
    x = views.images(spark, sf).select("image", values.alias("v")).select("image", V.pixel_normalise(F.col("v"), mean, std).alias("x"))
    return x.select("image", _r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


# ---- crops ----------------------------------------------------------------
@query("crop_flags", """WITH d AS (SELECT *, count(*) OVER (PARTITION BY text) > 1 AS dup FROM documents),
r AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN ['rna_only'] ELSE CAST([] AS VARCHAR[]) END AS given, quality IS NULL AS missing, CASE lang WHEN 'en' THEN 'verified' ELSE lang END AS st,
  CASE WHEN n_chars % 3 = 0 THEN 'predicted' ELSE 'experimental' END AS ty, dup, n_chars % 2 = 1 AS many FROM d LEFT JOIN labels USING (doc_id)),
f AS (SELECT doc_id, list_sort(list_distinct(list_filter(given || [CASE WHEN missing THEN 'coordinates_unavailable' END, CASE WHEN st <> 'verified' THEN 'source_mapping_' || st END,
  CASE WHEN ty <> 'experimental' THEN 'structure_' || ty END, CASE WHEN dup THEN 'duplicate_source_image' END, CASE WHEN many THEN 'panel_pdb_assignment_needed' END], lambda x: x IS NOT NULL))) AS review_flags FROM r)
SELECT doc_id, array_to_string(review_flags, ',') AS review_flags, CASE WHEN list_contains(review_flags, 'rna_only') THEN 'excluded' ELSE 'pending' END AS review_status,
 CASE WHEN list_contains(review_flags, 'rna_only') THEN 'rna_only' ELSE 'cartoon' END AS representation FROM f""")
def crop_flags(spark, sf):
    d = table(spark, sf, "documents")
    dup = Crops.duplicate_links(d, "text", "doc_id").select("doc_id", F.lit(True).alias("duplicate"))
    rows = d.join(table(spark, sf, "labels"), "doc_id", "left").join(dup, "doc_id", "left").select(
        "doc_id", F.when(F.col("toxic") == 1, F.array(F.lit("rna_only"))).otherwise(F.array().cast("array<string>")).alias("given_flags"),
        F.when(F.col("n_chars") % 2 == 1, "1abc; 2DEF").otherwise("1abc").alias("pdb_text"),
        F.when(F.col("lang") == "en", "verified").otherwise(F.col("lang")).alias("pdb_status"),
        F.when(F.col("n_chars") % 3 == 0, "predicted").otherwise("experimental").alias("structure_type"),
        F.coalesce("duplicate", F.lit(False)).alias("duplicate"), F.col("quality").isNull().alias("missing"))
    return Crops.crop_records(rows).select("doc_id", F.array_join("review_flags", ",").alias("review_flags"), "review_status", "representation")


@query("review_counts", "SELECT CASE WHEN toxic = 1 THEN 'excluded' WHEN quality = 1 THEN 'approved' ELSE 'pending' END AS review_status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def review_counts(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy(F.when(F.col("toxic") == 1, "excluded").when(F.col("quality") == 1, "approved").otherwise("pending").alias("review_status")).agg(F.count("*").alias("n"))


@query("flat_export", "WITH " + views.CROPS_SQL + """ SELECT crop_id, source_id, mapping_status, CAST(to_json(pdb_ids) AS VARCHAR) AS pdb_ids, CAST(to_json(review_flags) AS VARCHAR) AS review_flags FROM crops""")
def flat_export(spark, sf):
    return Crops.flat_columns(views.crops(spark, sf), ["crop_id", "source_id", "mapping_status", "pdb_ids", "review_flags"])
