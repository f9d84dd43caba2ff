"""Queries over runs of a batch: broken rules, states, jobs, reports of masks and trajectories, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators import batch as B
from framewright.operators import verification as C
from framewright.plans.visibility import FRAMES
from framewright.sources.tables import frames, table

EPISODE = "SELECT o_orderkey AS episode, CAST(floor(o_totalprice / 1000) AS BIGINT) AS frames FROM orders"


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode"), F.floor(F.col("o_totalprice") / 1000).alias("frames"), "o_orderstatus", "o_custkey")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks, each number of an order once."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("episode"), F.col("l_linenumber").alias("index")).agg(F.min("l_partkey").alias("start"), F.max("l_quantity").cast("long").alias("n"), F.min("l_suppkey").alias("host"))
    mode = F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("both")), (F.col("index") % 3 + 1).cast("int"))
    return lines.select("episode", "index", mode.alias("mode"), "start", (F.col("start") + F.col("n")).alias("stop"), "n", "host")


CHUNKS = """chunks AS (
    SELECT episode, i, ['left', 'right', 'both'][i % 3 + 1] AS mode, start, start + n AS stop, n, host, format('{:03d}_{}_{:05d}_{:05d}', i, ['left', 'right', 'both'][i % 3 + 1], start, start + n) AS name
    FROM (SELECT l_orderkey AS episode, l_linenumber AS i, min(l_partkey) AS start, CAST(max(l_quantity) AS BIGINT) AS n, min(l_suppkey) AS host FROM lineitem GROUP BY 1, 2)
)"""


def episode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of a run, on orders as recordings and lines as chunks; suppliers' numbers decide what is broken."""
    rows, chunks = _episodes(spark, sf_dir), _chunks(spark, sf_dir)
    named = chunks.select("episode", C.segment_name(F.col("index"), F.col("mode"), F.col("start"), F.col("stop")).alias("name"), "n", "host")
    metadata = rows.filter("o_custkey % 11 <> 0").select("episode", F.when(F.col("o_custkey") % 13 == 0, None).otherwise(F.col("frames") + (F.col("o_custkey") % 7 == 0).cast("long")).alias("total_frames"))
    backends = rows.filter("o_custkey % 5 <> 0").select("episode", F.when(F.col("o_custkey") % 4 == 0, "old").otherwise("direct").alias("backend"))
    videos = named.filter("host % 9 <> 0").select("episode", "name", F.when(F.col("host") % 8 == 0, 0).otherwise(100).alias("bytes"), F.when(F.col("host") % 6 != 0, F.col("n") - (F.col("host") % 5 == 0).cast("long")).alias("n"))
    finals = rows.filter("o_custkey % 3 <> 0").select("episode", F.lit("full.mp4").alias("name"), F.lit(9).alias("bytes"), F.col("frames").alias("n"))
    return C.episode_errors(
        rows.select("episode", "frames"), metadata, chunks.filter("host % 10 = 0").select("episode"), backends, chunks, named.filter("host % 12 <> 0").select("episode", "name"),
        named.filter("host % 7 <> 0").select("episode", "name", (F.col("n") + (F.col("host") % 11 == 0).cast("long")).alias("n")), videos.unionByName(finals), ["full.mp4"], "direct",
    )


ERRORS_SQL = f"""WITH {CHUNKS}, eps AS (SELECT o_orderkey AS episode, CAST(floor(o_totalprice / 1000) AS BIGINT) AS frames, o_custkey AS k FROM orders),
there AS (SELECT *, CASE WHEN k % 13 <> 0 THEN frames + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END END AS total FROM eps WHERE k % 11 <> 0), named AS (SELECT c.* FROM chunks c JOIN there t ON c.episode = t.episode),
clips AS (
    SELECT episode, name, n AS frames, host % 9 = 0 OR host % 8 = 0 AS missing, CASE WHEN host % 6 <> 0 THEN n - CASE WHEN host % 5 = 0 THEN 1 ELSE 0 END END AS got, 8 AS ord FROM named
    UNION ALL SELECT episode, 'full.mp4', frames, k % 3 = 0, frames, 10 FROM there
), masks AS (SELECT *, CASE WHEN host % 7 = 0 THEN 0 ELSE n + CASE WHEN host % 11 = 0 THEN 1 ELSE 0 END END AS m FROM named)
SELECT episode, 1 AS ord, 'missing metadata' AS message FROM eps WHERE k % 11 = 0
UNION ALL SELECT episode, 2, 'invalid metadata' FROM there WHERE total IS NULL
UNION ALL SELECT episode, 3, 'total_frames does not match the manifest' FROM there WHERE total <> frames
UNION ALL SELECT episode, 4, count(*) || ' skipped segments remain' FROM named WHERE host % 10 = 0 GROUP BY episode
UNION ALL SELECT episode, 5, 'missing pipeline provenance' FROM there WHERE k % 5 = 0
UNION ALL SELECT episode, 6, 'mask backend mismatch: expected direct, got old' FROM there WHERE k % 5 <> 0 AND k % 4 = 0
UNION ALL SELECT episode, 7, 'missing provenance for ' || name FROM named WHERE host % 12 = 0
UNION ALL SELECT episode, ord, CASE WHEN missing THEN 'missing video: ' || name WHEN got IS NULL THEN 'unreadable video ' || name ELSE 'frame mismatch ' || name || ': expected ' || frames || ', got ' || got END FROM clips WHERE missing OR got IS NULL OR got <> frames
UNION ALL SELECT episode, 9, 'mask count mismatch ' || name || ': expected ' || n || ', got ' || m FROM masks WHERE m <> n"""


def inspect_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as recordings: what inputs are there, and whether camera and table agree on their frames."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("episode"), F.col("c_nationkey").alias("k"))
    names = F.explode(F.array(F.lit("camera"), F.lit("poses"), F.lit("session"))).alias("name")
    inputs = rows.select("episode", "k", names).filter("NOT (name = 'session' AND k % 4 = 0) AND NOT (name = 'poses' AND k % 8 = 0)").select("episode", "name", (F.col("k") * 10 + F.length("name")).alias("bytes"))
    videos = rows.select("episode", F.when(F.col("k") % 2 == 0, 960).otherwise(640).alias("width"), F.lit(480).alias("height"), F.col("k").cast("long").alias("n"))
    tables = rows.select("episode", (F.col("k") + (F.col("k") % 5 == 0).cast("int")).cast("long").alias("rows"))
    return C.inspect_episodes(inputs, videos, tables, ["camera", "poses", "session"])


INSPECT_SQL = """WITH rows AS (SELECT c_custkey AS episode, c_nationkey AS k, CAST(c_nationkey + CASE WHEN c_nationkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n FROM customer)
SELECT episode, n AS frames, CAST(k * 10 + 6 + CASE WHEN k % 8 = 0 THEN 0 ELSE k * 10 + 5 END + CASE WHEN k % 4 = 0 THEN 0 ELSE k * 10 + 7 END AS BIGINT) AS input_bytes, CAST(n * CASE WHEN k % 2 = 0 THEN 2800000 ELSE 1100000 END AS BIGINT) AS scratch_bytes,
    CASE WHEN k % 8 = 0 THEN 'missing poses, session' WHEN k % 4 = 0 THEN 'missing session' WHEN n <> k THEN 'camera has ' || k || ' frames but the table has ' || n END AS problem FROM rows"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status texts of some orders, some of them cut off."""
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    whole = F.concat(F.lit('{"episode": '), F.col("o_orderkey").cast("string"), F.lit(', "state": "'), state, F.lit('"}'))
    text = F.when(F.col("o_custkey") % 10 == 0, F.substring(whole, 1, 14)).when(F.col("o_custkey") % 10 == 1, F.lit("{}")).otherwise(whole)
    return table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("episode"), text.alias("text"))


STATES = """states AS (
    SELECT o_orderkey AS episode, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'pending' WHEN o_custkey % 10 = 0 THEN 'invalid' WHEN o_custkey % 10 = 1 THEN 'pending' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'running' END AS state FROM orders
)"""


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.status_counts(_episodes(spark, sf_dir), _statuses(spark, sf_dir), "episode", "text")


STATUS_SQL = f"WITH {STATES} SELECT state, count(*) AS n FROM states GROUP BY 1"


def runnable_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of all recordings without retries, and the stages at which they go on or failed."""
    rows = _episodes(spark, sf_dir).join(_statuses(spark, sf_dir), "episode", "left").join(_chunks(spark, sf_dir).groupBy("episode").agg(F.count("*").alias("chunks"), F.sum("n").alias("masks")), "episode", "left")
    rows = rows.withColumn("status", C.status_of(F.col("text"))).withColumn("chunks", F.coalesce("chunks", F.lit(0))).withColumn("masks", F.coalesce("masks", F.lit(0)))
    state = B.episode_state(F.col("status"), F.col("masks") > 0, F.col("o_custkey") % 3 == 0, False)
    rows = rows.withColumn("state", state)
    resume = B.resume_stage(F.col("masks") > 200, F.col("chunks"), F.lit(4))
    failed = F.when(F.col("status") == "failed", B.failed_stage(F.col("chunks"), F.col("masks"), F.lit(4)))
    return rows.select("episode", "state", resume.alias("resume"), failed.alias("failed_at"))


QUEUE_SQL = f"""WITH {STATES}, {CHUNKS}, held AS (SELECT episode, count(*) AS c, CAST(sum(n) AS BIGINT) AS m FROM chunks GROUP BY 1),
rows AS (SELECT s.*, coalesce(c, 0) AS c, coalesce(m, 0) AS m FROM states s LEFT JOIN held h ON s.episode = h.episode)
SELECT episode, CASE WHEN state = 'completed' AND m > 0 THEN 'done' WHEN state = 'failed' THEN 'failed' WHEN o_custkey % 3 = 0 THEN 'claimed' ELSE 'runnable' END AS state,
    CASE WHEN m > 200 THEN 'compose' WHEN c = 4 THEN 'inpaint' ELSE 'segment' END AS resume, CASE WHEN state = 'failed' THEN CASE WHEN c = 4 THEN 'inpaint_or_compose' WHEN m = 4 THEN 'segment' ELSE 'trajectory_or_render' END END AS failed_at FROM rows"""


def next_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty recordings that can run, failed ones tried again."""
    rows = _episodes(spark, sf_dir).join(_statuses(spark, sf_dir), "episode", "left")
    state = B.episode_state(C.status_of(F.col("text")), F.col("frames") > 50, F.col("o_custkey") % 3 == 0, True)
    return C.runnable(rows, state, [F.col("episode")], 40).select("episode", "frames")


NEXT_SQL = f"""WITH {STATES} SELECT s.episode, CAST(floor(o_totalprice / 1000) AS BIGINT) AS frames FROM states s JOIN orders ON o_orderkey = s.episode
WHERE NOT (state = 'completed' AND floor(o_totalprice / 1000) > 50) AND s.o_custkey % 3 <> 0 ORDER BY 1 LIMIT 40"""


def chosen_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings named by a selector, all of which must be there."""
    low = table(spark, sf_dir, "customer").agg(F.min("c_custkey")).first()[0]
    names = B.selected(spark, f"{low}-{low + 20},{low + 3}")
    return C.chosen(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("episode"), "c_nationkey"), names, "episode")


CHOSEN_SQL = "SELECT c_custkey AS episode, c_nationkey FROM customer WHERE c_custkey <= (SELECT min(c_custkey) FROM customer) + 20"


def host_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of each nation with 1000 free: the preferred in their order, then the freest; the two best, one at least."""
    hosts = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.floor("s_acctbal").alias("free"))
    preferred = F.nullif(F.array_position(F.array(F.lit(3).cast("long"), F.lit(1).cast("long")), F.col("s_suppkey")), F.lit(0))
    return C.choose_hosts(hosts, ["s_nationkey"], "free", "s_suppkey", 1000, preferred, 2, 1).select("s_nationkey", "s_suppkey", "place", "freest")


HOST_SQL = """WITH hosts AS (SELECT s_nationkey, s_suppkey, CAST(floor(s_acctbal) AS BIGINT) AS free FROM supplier WHERE floor(s_acctbal) >= 1000),
placed AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE s_suppkey WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END, free DESC, s_suppkey) AS place,
    first_value(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY free DESC, s_suppkey DESC) AS freest FROM hosts)
SELECT s_nationkey, s_suppkey, place, freest FROM placed WHERE place <= 2"""


def segment_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment names parsed, unfolded to sides, without those that have a mask for each frame."""
    chunks = _chunks(spark, sf_dir)
    names = chunks.select("episode", C.segment_name(F.col("index"), F.col("mode"), F.col("start"), F.col("stop")).alias("name"), "n", "host")
    sides = C.sides_of(C.parse_segments(names, "name"))
    masks = sides.filter("host % 4 <> 0").select("episode", "name", "side", (F.col("n") - (F.col("host") % 5 == 0).cast("long")).alias("n"))
    return C.unfinished_sides(sides.drop("n", "host", "mode"), masks, ["episode", "name", "side"])


JOBS_SQL = f"""WITH {CHUNKS}, sides AS (SELECT episode, name, start, stop, host, unnest(CASE WHEN mode = 'both' THEN ['left', 'right'] ELSE [mode] END) AS side FROM chunks)
SELECT episode, name, side, start, stop FROM sides WHERE host % 4 = 0 OR host % 5 = 0"""


def compose_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose render is complete and which are not composed yet."""
    chunks = _chunks(spark, sf_dir)
    key = ["episode", "index"]
    return C.open_jobs(chunks.select(*key, "n"), chunks.select(*key, "n"), chunks.filter("host % 3 = 0").select(*key), key, "n")


COMPOSE_SQL = f'WITH {CHUNKS} SELECT episode, i AS "index", n FROM chunks WHERE host % 3 <> 0'


def whole_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that have both a trajectory and a composite; the others are left out."""
    chunks = _chunks(spark, sf_dir)
    key = ["episode", "index"]
    found = chunks.filter("host % 4 <> 1").select(*key, F.lit("poses").alias("kind")).unionByName(chunks.filter("host % 3 <> 1").select(*key, F.lit("composite").alias("kind")))
    return C.with_artifacts(chunks.select(*key, "mode"), found, key, "kind", ["poses", "composite"], False)


WHOLE_SQL = f'WITH {CHUNKS} SELECT episode, i AS "index", mode FROM chunks WHERE host % 4 <> 1 AND host % 3 <> 1'


def actuator_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each part's supplier-like number among suppliers first, else among customers; every name is known."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("number"), (F.col("c_nationkey") + 100).alias("place"))
    names = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("number")).join(customers.select("number"), "number", "left_semi")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("number"), F.col("s_nationkey").alias("place"))
    return C.in_order(names, suppliers, customers, "number", "place").select("o_orderkey", "place")


ACTUATOR_SQL = """SELECT o_orderkey, CAST(coalesce(s_nationkey, c_nationkey + 100) AS BIGINT) AS place FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_custkey"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an episode by twelves as masks of 40 x 12 cells."""
    return frames(spark, sf_dir).select("episode", F.floor(F.col("frame") / 12).alias("frame"), F.least(F.lit(39), F.floor(F.col("signal") / 10)).alias("x"), (F.col("frame") % 12).alias("y"), "event_type")


CELLS = f"{FRAMES}, cells AS (SELECT episode, frame // 12 AS frame, least(39, CAST(floor(signal / 10) AS BIGINT)) AS x, frame % 12 AS y, event_type FROM frames)"


def mask_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    return C.mask_report(cells.filter("event_type <> 'error'").select("episode", "frame", "x", "y"), cells.select("episode", "frame").distinct(), ["episode", "frame"], 40, 12, 10)


REPORT_SQL = f"""WITH {CELLS}, kept AS (SELECT DISTINCT episode, frame, x, y FROM cells WHERE event_type <> 'error'), held AS (SELECT episode, frame, count(*) AS area, bool_or(x IN (0, 39) OR y IN (0, 11)) AS border FROM kept GROUP BY 1, 2)
SELECT c.episode, c.frame, coalesce(area, 0) AS area, coalesce(border, false) AS border, coalesce(area, 0) < 10 AS small FROM (SELECT DISTINCT episode, frame FROM cells) c LEFT JOIN held h ON c.episode = h.episode AND c.frame = h.frame"""


def checked_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of two sides put together: frames that lack a side, differ in shape or are too small are named."""
    side = F.when(F.col("event_type").isin("click", "view"), "left").when(F.col("event_type") == "purchase", "right")
    rows = _cells(spark, sf_dir).select("episode", "frame", side.alias("side"), "x", "y", F.lit(40).alias("w"), F.when(F.col("x") > 38, 13).otherwise(12).alias("h")).filter("side is not null")
    return C.union_checked(rows, "episode", "frame", 2, 6)


UNION_SQL = f"""WITH {CELLS}, rows AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'left' WHEN event_type = 'purchase' THEN 'right' END AS side, CASE WHEN x > 38 THEN 13 ELSE 12 END AS h FROM cells)
SELECT episode, frame, count(DISTINCT (x, y)) AS area, CASE WHEN count(DISTINCT side) < 2 THEN 'a side is missing' WHEN count(DISTINCT h) > 1 THEN 'shapes differ' WHEN count(DISTINCT (x, y)) < 6 THEN 'too small' END AS problem
FROM rows WHERE side IS NOT NULL GROUP BY 1, 2"""


def split_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose robot mask is not the disjoint union of its arm's and its hand's."""
    part = F.explode(F.when(F.col("event_type") == "error", F.array(F.lit("robot"))).when(F.col("event_type") == "view", F.array(F.lit("robot"), F.lit("arm"))).otherwise(F.array(F.lit("robot"), F.lit("hand"))))
    cells = _cells(spark, sf_dir).filter("event_type <> 'error' OR x > 25").select("episode", "frame", part.alias("part"), "x", "y")
    return C.split_errors(cells, ["episode", "frame"])


SPLIT_SQL = f"""WITH {CELLS}, one AS (SELECT episode, frame, x, y, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS arm, max(CASE WHEN event_type NOT IN ('view', 'error') THEN 1 ELSE 0 END) AS hand FROM cells WHERE event_type <> 'error' OR x > 25 GROUP BY ALL)
SELECT DISTINCT episode, frame FROM one WHERE arm + hand <> 1"""


def trajectory_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five joints of each recording from its vectors, residuals from their next numbers."""
    place = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("episode"), place.cast("long").alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    values = rows.select("episode", "frame", F.posexplode(F.slice("e", 1, 5)).alias("joint", "q")).filter("NOT (episode = 3 AND joint = 4 AND frame = 0)").withColumn("low", F.lit(-0.45)).withColumn("high", F.lit(0.45))
    errors = rows.select("episode", "frame", (F.abs(F.col("e")[6]) / 40 - (F.col("episode") == 5).cast("int")).alias("position"), (F.abs(F.col("e")[7]) * 13).alias("orientation"))
    return C.trajectory_errors(values, errors, rows.groupBy("episode").agg(F.count("*").alias("frames")), ["episode"])


TRAJECTORY_SQL = """WITH rows AS (SELECT CAST(label AS BIGINT) AS episode, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
rest AS (SELECT episode, max(abs(e[7]) / 40 - CASE WHEN episode = 5 THEN 1 ELSE 0 END) AS p, min(abs(e[7]) / 40 - CASE WHEN episode = 5 THEN 1 ELSE 0 END) AS least, max(abs(e[8]) * 13) AS o FROM rows GROUP BY 1)
SELECT DISTINCT episode, 1 AS ord, 'a joint has other frames than the run' AS message FROM rows WHERE episode = 3
UNION ALL SELECT DISTINCT episode, 3, 'a joint leaves its limits' FROM (SELECT episode, frame, unnest(e[1:5]) AS q, unnest(range(5)) AS joint FROM rows) WHERE abs(q) > 0.45001 AND NOT (episode = 3 AND joint = 4 AND frame = 0)
UNION ALL SELECT episode, 4, 'a residual is not finite or negative' FROM rest WHERE least < 0
UNION ALL SELECT episode, 5, 'a position residual is over 0.01' FROM rest WHERE p > 0.01 UNION ALL SELECT episode, 6, 'an orientation residual is over 5 degrees' FROM rest WHERE o > 5"""


def code_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a host as the files of a program."""
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), F.concat(F.col("url"), F.lit("#"), F.col("page_id").cast("string")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return C.fingerprint(rows, ["host"])


FINGERPRINT_SQL = """SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
    sha256(unhex(string_agg(hex(encode(url || '#' || page_id)) || '00' || hex(encode(html)) || '00', '' ORDER BY encode(url || '#' || page_id)))) AS sha256 FROM pages GROUP BY 1"""


def file_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), F.col("page_id").cast("string").alias("path"), F.octet_length("html").cast("long").alias("length"), (F.col("page_id") * 7).alias("modificationTime"))
    out = C.signature(rows, ["host"])
    entry = F.transform(F.map_entries("signature"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["size"].cast("string"), F.lit(":"), e["value"]["mtime"].cast("string")))
    return out.select("host", F.array_join(entry, ",").alias("signature"))


SIGNATURE_SQL = """SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, string_agg(page_id || ':' || octet_length(encode(html)) || ':' || page_id * 7, ',' ORDER BY CAST(page_id AS VARCHAR)) AS signature FROM pages GROUP BY 1"""


def hash_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of all pages: two thirds of them are known from before, with address, size and time, some of those out of date; the rest are hashed."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.col("url"), F.lit("#"), F.col("page_id").cast("string")).alias("path"), F.octet_length("html").cast("long").alias("length"), (F.col("page_id") * 7).alias("modificationTime"), F.encode("html", "UTF-8").alias("content"), "page_id")
    known = pages.filter("page_id % 3 <> 0").select("path", "length", (F.col("modificationTime") + (F.col("page_id") % 5 == 0).cast("long")).alias("modificationTime"), F.concat(F.lit("known "), F.col("page_id").cast("string")).alias("sha256"))
    return B.file_hashes(pages.drop("page_id"), known).select("path", "sha256")


CACHE_SQL = "SELECT url || '#' || page_id AS path, CASE WHEN page_id % 3 <> 0 AND page_id % 5 <> 0 THEN 'known ' || page_id ELSE sha256(html) END AS sha256 FROM pages"


def first_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as attempts: the first that succeeded; continued runs have one attempt."""
    rows = _chunks(spark, sf_dir).select("episode", "index", (F.col("host") % 4 == 0).alias("ok"), "host")
    return C.first_success(rows, ["episode"], "index", "ok", "host", F.col("episode") % 5 == 0)


BRANCH_SQL = f"""WITH {CHUNKS}, placed AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY i) AS place FROM chunks)
SELECT episode, arg_min(host, place) FILTER (host % 4 = 0 AND (episode % 5 <> 0 OR place = 1)) AS host FROM placed GROUP BY 1"""


def prompt_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    return C.prompt_status(rows.select("episode", "frame"), rows.filter("frame % 7 = 0 AND event_type <> 'error'"), ["episode", "frame"])


PROMPTED_SQL = f"WITH {FRAMES} SELECT episode, frame, CASE WHEN frame % 7 = 0 AND event_type <> 'error' THEN 'prompted' ELSE 'propagated' END AS status FROM frames"

QUERIES = {
    "episode_errors": (episode_errors, ERRORS_SQL),
    "inspect_episodes": (inspect_episodes, INSPECT_SQL),
    "status_counts": (status_counts, STATUS_SQL),
    "runnable_queue": (runnable_queue, QUEUE_SQL),
    "next_episodes": (next_episodes, NEXT_SQL),
    "chosen_episodes": (chosen_episodes, CHOSEN_SQL),
    "host_choice": (host_choice, HOST_SQL),
    "segment_jobs": (segment_jobs, JOBS_SQL),
    "compose_jobs": (compose_jobs, COMPOSE_SQL),
    "whole_segments": (whole_segments, WHOLE_SQL),
    "actuator_order": (actuator_order, ACTUATOR_SQL),
    "mask_report": (mask_report, REPORT_SQL),
    "checked_union": (checked_union, UNION_SQL),
    "split_masks": (split_masks, SPLIT_SQL),
    "trajectory_errors": (trajectory_errors, TRAJECTORY_SQL),
    "code_fingerprint": (code_fingerprint, FINGERPRINT_SQL),
    "file_signature": (file_signature, SIGNATURE_SQL),
    "hash_cache": (hash_cache, CACHE_SQL),
    "first_branches": (first_branches, BRANCH_SQL),
    "prompt_status": (prompt_status, PROMPTED_SQL),
}
