"""Keys, chains, scans, splits and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxelmill.functions import chemistry, expressions as X
from voxelmill.functions.expressions import rounded
from voxelmill.functions.keys import entry_code, entry_code_sql
from voxelmill.operators import sampling
from voxelmill.plans.registry import PTS, RES, points, query, residues
from voxelmill.sources import files, structures
from voxelmill.sources.tables import table

IDS = "ids AS (SELECT row_id, protein_id, 0 AS split FROM train_ids UNION ALL SELECT row_id, protein_id, 1 FROM val_ids UNION ALL SELECT row_id, protein_id, 2 FROM test_ids)"
STEM = r"regexp_replace(regexp_replace(protein_id, '^.*[/\\]', ''), '\.[A-Za-z0-9]+$', '')"


def ids(spark: SparkSession, sf: str) -> DataFrame:
    """The three lists as one: ``row_id, protein_id, split``."""
    parts = [table(spark, sf, f"{n}_ids").select("row_id", "protein_id", F.lit(k).alias("split")) for k, n in enumerate(("train", "val", "test"))]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH {IDS} SELECT row_id, {entry_code_sql('protein_id')} AS entry, {STEM} AS stem, lower(regexp_replace({STEM}, '_[A-Za-z]{{1,2}}$', '')) AS base FROM ids")
def key_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Entry, file stem and stem without a chain of every listed id."""
    stem = X.stem(F.col("protein_id"))
    return ids(spark, sf).select("row_id", entry_code(F.col("protein_id")).alias("entry"), stem.alias("stem"), F.lower(X.strip_chain(stem)).alias("base"))


@query(f"WITH {IDS} SELECT row_id, lower(nullif(regexp_extract(replace(protein_id, ':', '_'), '{X.PDB4_STRICT}', 2), '')) AS code FROM ids")
def pdb4_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Free-standing four-character codes."""
    return ids(spark, sf).select("row_id", X.pdb4_strict(F.col("protein_id")).alias("code"))


@query(f"WITH {IDS} SELECT row_id, nullif(regexp_extract(lower(replace(split_part(split_part(trim(protein_id), ' ', 1), '.', 1), ':', '_')), '{X.PDB4_LOOSE}', 1), '') AS code FROM ids")
def pdb4_loose(spark: SparkSession, sf: str) -> DataFrame:
    """Four-character codes anywhere before the first dot."""
    return ids(spark, sf).select("row_id", X.pdb4_loose(F.col("protein_id")).alias("code"))


@query(r"""WITH n AS (SELECT protein_no, any_value(trim(protein_key)) AS k FROM proteins GROUP BY protein_no),
m AS (SELECT protein_no, k, regexp_extract(k, '_([A-Za-z]{1,2})$', 1) AS token FROM n)
SELECT protein_no, lower(CASE WHEN token <> '' THEN regexp_replace(k, '_[A-Za-z]{1,2}$', '') WHEN NOT contains(k, '_') AND regexp_matches(k, '[A-Z]$') THEN substring(k, 1, length(k)-1) ELSE k END) AS base,
  CASE WHEN token <> '' THEN token WHEN NOT contains(k, '_') AND regexp_matches(k, '[A-Z]$') THEN right(k, 1) END AS chain FROM m""".replace("any_value(trim(protein_key))", "min(trim(protein_key))"))
def embedding_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Protein and chain as embedding files name them."""
    names = table(spark, sf, "proteins").groupBy("protein_no").agg(F.min(F.trim("protein_key")).alias("k"))
    base, chain = X.embedding_key(F.col("k"))
    return names.select("protein_no", base.alias("base"), chain.alias("chain"))


@query(f"WITH {PTS} SELECT point_id, concat_ws(':', protein_key, coalesce(chain_id, 'A'), CAST(residue_number AS VARCHAR)) AS residue_id, lower(protein_key) || '_' || coalesce(chain_id, 'A') AS key FROM pts")
def residue_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Residue ids ``pid:chain:num`` and the keys read back from them."""
    rid = X.residue_id(F.col("protein_key"), F.coalesce("chain_id", F.lit("A")), F.col("residue_number"))
    return points(spark, sf).select("point_id", rid.alias("residue_id")).withColumn("key", X.key_of_residue_id(F.col("residue_id")))


@query("""WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, coalesce(try_cast(k AS DOUBLE), 0.0) AS value, coalesce(CAST(trunc(try_cast(k AS DOUBLE)) AS INT), -1) AS number FROM e""")
def safe_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers out of text, with what stands for invalid ones."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", X.safe_double(k).alias("value"), X.int_of_text(k).alias("number"))


@query("""WITH p AS (SELECT DISTINCT point_id, file_name, chain_id, residue_number FROM sas_points),
reg AS (SELECT file_name, min(upper(trim(chain_id))) AS c FROM p WHERE trim(chain_id) <> '' GROUP BY file_name),
r AS (SELECT point_id, p.file_name, coalesce(upper(nullif(trim(chain_id), '')), c, 'A') AS chain, CASE WHEN residue_number >= 0 THEN residue_number END AS n FROM p LEFT JOIN reg ON p.file_name = reg.file_name)
SELECT point_id, chain, coalesce(n, CAST(sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY file_name, chain ORDER BY point_id) AS INT)) AS residue FROM r""")
def chain_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """The row's chain, else the first one seen in its file, else A; residue numbers with a running count for invalid ones."""
    rows = table(spark, sf, "sas_points").select("point_id", "file_name", "chain_id", "residue_number").distinct()
    own = F.nullif(F.trim("chain_id"), F.lit(""))
    registry = rows.where(own.isNotNull()).groupBy("file_name").agg(F.min(F.upper(own)).alias("seen"))
    resolved = rows.join(registry, "file_name", "left").select("point_id", "file_name", F.coalesce(F.upper(own), "seen", F.lit("A")).alias("chain"), "residue_number")
    number = F.when(F.col("residue_number") >= 0, F.col("residue_number"))
    return sampling.running_fallback(resolved, ["file_name", "chain"], "point_id", number).select("point_id", "chain", "residue")


LONGEST = 24  # signs of an id that is looked for inside keys


@query(f"""WITH {IDS}, q AS (SELECT row_id, {STEM} AS name, {entry_code_sql('protein_id')} AS entry FROM ids),
k AS (SELECT DISTINCT trim(protein_key) AS key FROM proteins), ke AS (SELECT key, {entry_code_sql('key')} AS entry FROM k),
m AS (SELECT row_id, 1 AS class, key FROM q JOIN k ON name = key UNION ALL SELECT row_id, 2, key FROM q JOIN k ON lower(name) = lower(key)
  UNION ALL SELECT row_id, 3, key FROM q JOIN k ON lower(name) = lower(regexp_replace(key, '_[A-Za-z]{{1,2}}$', '')) UNION ALL SELECT row_id, 4, key FROM q JOIN k ON length(name) BETWEEN 3 AND {LONGEST} AND contains(lower(key), lower(name))
  UNION ALL SELECT row_id, 5, key FROM q JOIN ke ON q.entry = ke.entry UNION ALL SELECT row_id, 6, (SELECT min(key) FROM k) FROM q WHERE name IS NOT NULL)
SELECT row_id, CAST(class AS INT) AS class, key FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY class, key) AS r FROM m) WHERE r = 1""")
def fuzzy_id_match(spark: SparkSession, sf: str) -> DataFrame:
    """The best key for each id: equal, equal but for case, equal without the chain, holding the id, naming the same entry, else the first key. Every class but the last is an equi-join; ids inside keys meet the keys' substrings."""
    q = ids(spark, sf).select("row_id", X.stem(F.col("protein_id")).alias("name"), entry_code(F.col("protein_id")).alias("entry"))
    k = table(spark, sf, "proteins").select(F.trim("protein_key").alias("key")).where("key IS NOT NULL").distinct()
    keyed = k.select("key", F.lower("key").alias("low"), F.lower(X.strip_chain(F.col("key"))).alias("bare"), entry_code(F.col("key")).alias("code"))
    inside = keyed.select("key", F.explode(files.substrings(F.col("low"), 3, LONGEST)).alias("part"))
    match = lambda a, b, c, right=keyed: q.join(right, a == b).select("row_id", F.lit(c).alias("class"), "key")
    low = F.lower("name")
    every = match(F.col("name"), F.col("key"), 1).union(match(low, F.col("low"), 2)).union(match(low, F.col("bare"), 3)).union(match(low, F.col("part"), 4, inside)).union(match(F.col("entry"), F.col("code"), 5))
    first = k.select(F.min("key")).scalar()
    every = every.union(q.where("name IS NOT NULL").select("row_id", F.lit(6).alias("class"), first.alias("key")))
    return every.groupBy("row_id").agg(F.min(F.struct("class", "key")).alias("b")).select("row_id", "b.class", "b.key")


@query(f"WITH {IDS} SELECT row_id, split, {entry_code_sql('protein_id')} IN (SELECT {entry_code_sql('protein_id')} FROM test_ids WHERE {entry_code_sql('protein_id')} IS NOT NULL) AS held_out FROM ids WHERE {entry_code_sql('protein_id')} IS NOT NULL")
def heldout_split(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a listed id names an entry of the test list."""
    rows = ids(spark, sf).select("row_id", "split", entry_code(F.col("protein_id")).alias("entry")).where("entry IS NOT NULL")
    held = rows.where("split = 2").select("entry").distinct().withColumn("h", F.lit(True))
    return rows.join(held, "entry", "left").select("row_id", "split", F.coalesce("h", F.lit(False)).alias("held_out"))


@query(f"WITH {IDS}, e AS (SELECT {entry_code_sql('protein_id')} AS entry, split FROM ids) SELECT entry, count(DISTINCT split) AS splits, count(*) AS rows FROM e WHERE entry IS NOT NULL GROUP BY entry HAVING count(DISTINCT split) > 1")
def leakage_check(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that stand in more than one list."""
    return sampling.leaking(ids(spark, sf).select(entry_code(F.col("protein_id")).alias("entry"), "split"), "entry", "split")


@query(f"""WITH {IDS}, e AS (SELECT row_id, {entry_code_sql('protein_id')} AS entry, split FROM ids), v AS (SELECT entry, split, count(*) AS n FROM e WHERE entry IS NOT NULL GROUP BY ALL),
b AS (SELECT entry, split FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY n DESC, split) AS r FROM v) WHERE r = 1)
SELECT row_id, coalesce(b.split, e.split) AS new_split FROM e LEFT JOIN b ON e.entry = b.entry""")
def leakage_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry in one split, the one that holds most of it."""
    rows = ids(spark, sf).select("row_id", entry_code(F.col("protein_id")).alias("entry"), "split")
    return sampling.resolve_leaks(rows, "entry", "split").select("row_id", "new_split")


FIRST = "f AS (SELECT DISTINCT sample_id, lower(protein_key) AS k, split FROM sample_store), s AS (SELECT k, split FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sample_id, split NULLS FIRST) AS r FROM f) WHERE r = 1)"


@query(f"WITH {FIRST} SELECT k AS protein, CAST(split AS INT) AS split FROM s WHERE split IN (0, 1) OR NOT EXISTS (SELECT 1 FROM s WHERE split IN (0, 1))")
def split_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Proteins of train and validation, by the split of their first sample; all of them if there are none."""
    rows = table(spark, sf, "sample_store").select("sample_id", F.lower("protein_key").alias("protein"), F.col("split").cast("int").alias("split"))
    return sampling.in_splits(rows, "protein", "sample_id", "split", [0, 1])


@query(f"WITH {FIRST} SELECT k AS protein, CAST(split AS INT) AS split FROM s WHERE split = 9 OR NOT EXISTS (SELECT 1 FROM s WHERE split = 9)")
def split_filter_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A split that no protein is in gives all proteins."""
    rows = table(spark, sf, "sample_store").select("sample_id", F.lower("protein_key").alias("protein"), F.col("split").cast("int").alias("split"))
    return sampling.in_splits(rows, "protein", "sample_id", "split", [9])


@query("""WITH k AS (SELECT DISTINCT lower(protein_key) AS k FROM sample_store WHERE protein_key IS NOT NULL), n AS (SELECT round_even(count(*) * 0.15, 0) AS n FROM k),
r AS (SELECT k, row_number() OVER (ORDER BY md5('42:' || k), k) AS r FROM k) SELECT k AS protein, r <= n AS held FROM r CROSS JOIN n""")
def group_split(spark: SparkSession, sf: str) -> DataFrame:
    """Proteins held out: round-half-even of 15 percent, the same on every run."""
    keys = table(spark, sf, "sample_store").select(F.lower("protein_key").alias("protein")).where("protein IS NOT NULL")
    return sampling.exact_split(keys, "protein", 0.15, 42)


@query(f"""WITH {IDS}, e AS (SELECT row_id, {entry_code_sql('protein_id')} AS entry, split FROM ids), k AS (SELECT DISTINCT entry FROM e WHERE entry IS NOT NULL), n AS (SELECT round_even(count(*) * 0.2, 0) AS n FROM k),
r AS (SELECT entry, row_number() OVER (ORDER BY md5('7:' || entry), entry) AS r FROM k), h AS (SELECT entry, CASE WHEN r <= n THEN 1 ELSE 0 END AS held FROM r CROSS JOIN n)
SELECT row_id, CAST(coalesce(held, split) AS INT) AS new_split FROM e LEFT JOIN h ON e.entry = h.entry""")
def entry_resplit(spark: SparkSession, sf: str) -> DataFrame:
    """A new split by entries, a fifth of them held out; rows that name no entry keep theirs."""
    rows = ids(spark, sf).select("row_id", entry_code(F.col("protein_id")).alias("entry"), "split")
    return sampling.resplit_entities(rows, "entry", "split", 0.2, 7).select("row_id", "new_split")


@query("""WITH k AS (SELECT DISTINCT protein_no FROM proteins), h AS (SELECT protein_no, CAST(CAST('0x' || substr(md5('0:' || CAST(protein_no AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS x FROM k)
SELECT protein_no, CASE WHEN x < 0.8 THEN 'train' WHEN x < 0.9 THEN 'val' ELSE 'test' END AS split FROM h""")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    """A split by hash of the chain's number."""
    return sampling.hash_split(table(spark, sf, "proteins").select("protein_no").distinct(), "protein_no", {"train": 0.8, "val": 0.1, "test": 0.1})


@query("""WITH c AS (SELECT event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) AND row_number() OVER (ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT *, sum(new) OVER (ORDER BY event_id) AS island FROM c)
SELECT CAST(island AS BIGINT) AS island, any_value(event_type) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM i GROUP BY island""")
def islands_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of equal event types in order of ids."""
    return files.islands(table(spark, sf, "events"), "event_type", "event_id")


@query(f"WITH {PTS} SELECT point_id, residue_name, chain_id, residue_number, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, 0.0 AS occupancy, 'C' AS element FROM pts WHERE residue_name IS NOT NULL AND chain_id IS NOT NULL AND residue_number >= 0".replace("0.0 AS occupancy", "CAST(0 AS DOUBLE) AS occupancy"))
def structure_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Points written as fixed-width records and read back by columns."""
    rows = points(spark, sf).where("residue_name IS NOT NULL AND chain_id IS NOT NULL AND residue_number >= 0")
    lines = rows.select("point_id", structures.record_line("ATOM", F.col("point_idx"), F.lit("CA"), F.col("residue_name"), F.col("chain_id"), F.col("residue_number"), (F.col("x"), F.col("y"), F.col("z"))).alias("line"))
    return structures.parse_atoms(lines).select("point_id", "residue_name", "chain_id", "residue_number", "x", "y", "z", "occupancy", "element")


LETTERS = ", ".join(f"('{k}', '{v}')" for k, v in structures.LETTERS.items())


@query(f"""WITH l(residue_name, letter) AS (VALUES {LETTERS}), r AS (SELECT protein_key, res_id, min(letter) AS letter FROM residues JOIN l ON res_name = residue_name WHERE res_id IS NOT NULL GROUP BY ALL)
SELECT protein_key, string_agg(letter, '' ORDER BY res_id) AS sequence, count(*) AS n FROM r GROUP BY protein_key""")
def residue_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences of standard residues in order of their numbers."""
    rows = table(spark, sf, "residues").where("res_id IS NOT NULL").select("protein_key", F.lit("ATOM").alias("record"), F.lit("CA").alias("atom_name"), F.col("res_name").alias("residue_name"), F.col("res_id").alias("residue_number"))
    return structures.sequences(rows, ["protein_key"]).select("protein_key", "sequence", F.size("numbers").cast("long").alias("n"))


@query(f"WITH {PTS} SELECT protein_key, residue_number, min(point_id) AS first_point, count(*) AS points, string_agg(CAST(point_id AS VARCHAR), ',' ORDER BY point_id) AS ids FROM pts GROUP BY ALL")
def residue_index(spark: SparkSession, sf: str) -> DataFrame:
    """Points by protein and residue, the first one standing for it; a residue has few points."""
    listed = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("point_id")), lambda i: i.cast("string")))
    return points(spark, sf).groupBy("protein_key", "residue_number").agg(F.min("point_id").alias("first_point"), F.count("*").alias("points"), listed.alias("ids"))


@query(f"WITH {PTS} SELECT protein_key, residue_number, max(point_id) AS point_id, arg_max(x, point_id) AS x, arg_max(y, point_id) AS y, arg_max(z, point_id) AS z FROM pts GROUP BY ALL")
def last_point_per_residue(spark: SparkSession, sf: str) -> DataFrame:
    """The last point of every residue gives its place."""
    at = F.max_by(F.struct("x", "y", "z"), "point_id").alias("p")
    return points(spark, sf).groupBy("protein_key", "residue_number").agg(F.max("point_id").alias("point_id"), at).select("protein_key", "residue_number", "point_id", "p.x", "p.y", "p.z")


DIM = ", ".join(f"('{k}', {v})" for k, v in chemistry.HYDROPATHY.items()) + ", " + ", ".join(f"('{k}', {chemistry.HYDROPATHY[v]})" for k, v in chemistry.STANDARD.items())


@query(f"WITH {PTS}, d(n, h) AS (VALUES {DIM}) SELECT protein_key, round(avg(coalesce(h, 0)), 6) AS hydropathy, count(*) FILTER (WHERE upper(trim(residue_name)) IN ('ASP', 'GLU')) AS acidic FROM pts LEFT JOIN d ON upper(trim(residue_name)) = n GROUP BY protein_key")
def residue_chemistry(spark: SparkSession, sf: str) -> DataFrame:
    """Mean hydropathy and acidic points of a protein, from the residue dimension."""
    rows = chemistry.with_chemistry(points(spark, sf).select("protein_key", "residue_name"))
    return rows.groupBy("protein_key").agg(rounded(F.avg("hydropathy"), 6).alias("hydropathy"), F.sum("acidic").cast("long").alias("acidic"))


@query(f"""WITH {PTS}, {RES}, one AS (SELECT protein_key, res_id, avg(rsa) AS rsa FROM res WHERE rsa IS NOT NULL GROUP BY ALL), m AS (SELECT protein_key, avg(rsa) AS mean FROM res WHERE rsa IS NOT NULL GROUP BY ALL)
SELECT point_id, round(coalesce(one.rsa, m.mean), 6) AS rsa, one.rsa IS NULL AS filled FROM pts LEFT JOIN one ON pts.protein_key = one.protein_key AND residue_number = res_id LEFT JOIN m ON pts.protein_key = m.protein_key""")
def residue_mean_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A value of the point's residue, else the mean of its protein."""
    rows = residues(spark, sf).where("rsa IS NOT NULL")
    one = rows.groupBy("protein_key", F.col("res_id").alias("residue_number")).agg(F.avg("rsa").alias("own"))
    mean = rows.groupBy("protein_key").agg(F.avg("rsa").alias("mean"))
    out = points(spark, sf).select("point_id", "protein_key", "residue_number").join(one, ["protein_key", "residue_number"], "left").join(mean, "protein_key", "left")
    return out.select("point_id", rounded(F.coalesce("own", "mean"), 6).alias("rsa"), F.col("own").isNull().alias("filled"))


@query(f"""WITH {PTS}, s AS (SELECT DISTINCT ON (sample_id) sample_id, lower(split_part(protein_key, '_', 1)) || '_' || upper(split_part(protein_key, '_', 2)) AS k, point_idx, neighbor_idx FROM sample_store),
n AS (SELECT sample_id, k, unnest(neighbor_idx) AS i FROM s), v AS (SELECT sample_id, prob FROM n JOIN pts ON k = protein_key AND i = pts.point_idx),
a AS (SELECT sample_id, avg(prob) AS m, count(*) AS c FROM v GROUP BY sample_id)
SELECT s.sample_id, round(coalesce(m, p.prob), 6) AS context, coalesce(c, 0) AS neighbours FROM s LEFT JOIN a ON s.sample_id = a.sample_id LEFT JOIN pts p ON s.k = p.protein_key AND s.point_idx = p.point_idx""")
def neighbour_gather(spark: SparkSession, sf: str) -> DataFrame:
    """Mean value of each sample's listed neighbours; its own where the list gives none."""
    parts = F.split("protein_key", "_")
    key = F.concat(F.lower(F.get(parts, F.lit(0))), F.lit("_"), F.upper(F.get(parts, F.lit(1))))
    s = table(spark, sf, "sample_store").dropDuplicates(["sample_id"]).select("sample_id", key.alias("protein_key"), "point_idx", "neighbor_idx")
    value = points(spark, sf).select("protein_key", "point_idx", "prob")
    listed = s.select("sample_id", "protein_key", F.explode("neighbor_idx").alias("point_idx")).join(value, ["protein_key", "point_idx"])
    mean = listed.groupBy("sample_id").agg(F.avg("prob").alias("m"), F.count("*").alias("c"))
    out = s.join(mean, "sample_id", "left").join(value, ["protein_key", "point_idx"], "left")
    return out.select("sample_id", rounded(F.coalesce("m", "prob"), 6).alias("context"), F.coalesce("c", F.lit(0)).alias("neighbours"))


@query(f"""WITH {PTS}, {RES}, s AS (SELECT DISTINCT ON (sample_id) sample_id, lower(split_part(protein_key, '_', 1)) || '_' || upper(split_part(protein_key, '_', 2)) AS k, point_idx, residue_number, neighbor_resnums FROM sample_store),
one AS (SELECT protein_key, res_id, avg(rsa) AS v FROM res WHERE rsa IS NOT NULL GROUP BY ALL), n AS (SELECT sample_id, k, unnest(neighbor_resnums) AS i FROM s), a AS (SELECT sample_id, avg(v) AS m, count(*) AS c FROM n JOIN one ON k = protein_key AND i = res_id GROUP BY sample_id)
SELECT s.sample_id, round(o.v, 6) AS centre, round(coalesce(a.m, o.v), 6) AS residues, coalesce(c, 0) AS found FROM s LEFT JOIN a ON a.sample_id = s.sample_id LEFT JOIN one o ON o.protein_key = s.k AND o.res_id = s.residue_number""")
def residue_gather(spark: SparkSession, sf: str) -> DataFrame:
    """The other modes of a sample's context: the value of its own residue, and the mean over the residues that it lists, its own where none is found."""
    parts = F.split("protein_key", "_")
    key = X.protein_key(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    s = table(spark, sf, "sample_store").dropDuplicates(["sample_id"]).select("sample_id", key.alias("protein_key"), F.col("residue_number").alias("res_id"), "neighbor_resnums")
    value = residues(spark, sf).where("rsa IS NOT NULL").groupBy("protein_key", "res_id").agg(F.avg("rsa").alias("v"))
    listed = s.select("sample_id", "protein_key", F.explode("neighbor_resnums").alias("res_id")).join(value, ["protein_key", "res_id"]).groupBy("sample_id").agg(F.avg("v").alias("m"), F.count("*").alias("c"))
    out = s.join(value, ["protein_key", "res_id"], "left").join(listed, "sample_id", "left")
    return out.select("sample_id", rounded(F.col("v"), 6).alias("centre"), rounded(F.coalesce("m", "v"), 6).alias("residues"), F.coalesce("c", F.lit(0)).alias("found"))


@query("""WITH s AS (SELECT DISTINCT ON (sample_id) sample_id, split, label FROM sample_store), o AS (SELECT sample_id FROM s WHERE label = 1 AND sample_id % 2 = 0)
SELECT sample_id, CAST(unnest([1, 2]) AS INT) AS copy FROM s WHERE split = 0 AND sample_id IN (SELECT sample_id FROM o)""")
def train_override(spark: SparkSession, sf: str) -> DataFrame:
    """The training samples that a list names, and only those, each twice."""
    rows = table(spark, sf, "sample_store").select("sample_id", "split", "label").dropDuplicates(["sample_id"])
    listed = rows.where("label = 1 AND sample_id % 2 = 0").select("sample_id")  # the list of the test, not a subset of the work
    return sampling.repeat(rows.where("split = 0").join(listed, "sample_id", "left_semi").select("sample_id"), F.lit(2)).select("sample_id", "copy")
