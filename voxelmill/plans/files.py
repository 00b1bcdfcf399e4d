"""Scans and sinks as round trips through files and text, lookups of names and paths, small forward passes, and selections for display."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxelmill.functions import expressions as X
from voxelmill.functions.expressions import rounded
from voxelmill.functions.keys import entry_code, entry_code_sql
from voxelmill.operators import metrics as M, sampling, scoring
from voxelmill.plans.pockets import BASE, BOTH, _sites, compared, pockets
from voxelmill.plans.pipeline import ATOMS, parsed_atoms
from voxelmill.plans.prep import IDS, STEM, ids
from voxelmill.plans.registry import PTS, RES, SCORED, points, query, residues, scored
from voxelmill.sources import files, sinks, structures
from voxelmill.sources.tables import table
from voxelmill.storage import keep, materialize

THREE = "CAST(printf('%.3f', {0}) AS DOUBLE)"


@query(f"""WITH {PTS}, h AS (SELECT DISTINCT ON (point_id) protein_key, point_id, chain_id, residue_number, {", ".join(f"{THREE.format(a)} AS {a}" for a in "xyz")} FROM pts WHERE label = 1 AND length(chain_id) = 1 AND chain_id <> ' ' AND residue_number BETWEEN 0 AND 9999)
SELECT protein_key, chain_id, residue_number, count(*) AS atoms, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z FROM h GROUP BY ALL HAVING count(*) >= 3""")
def ligand_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Ligands out of HETATM lines: labelled points as atoms of a ligand, others as water."""
    rows = points(spark, sf).where("length(chain_id) = 1 AND chain_id <> ' ' AND residue_number BETWEEN 0 AND 9999").dropDuplicates(["point_id"])
    name = F.when(F.col("label") == 1, "LIG").otherwise("HOH")
    line = structures.record_line("HETATM", F.col("point_idx"), F.lit("C1"), name, F.col("chain_id"), F.col("residue_number"), (F.col("x"), F.col("y"), F.col("z")))
    found = structures.ligands(structures.parse_atoms(rows.select("protein_key", line.alias("line"))), ["protein_key"])
    return found.select("protein_key", "chain_id", "residue_number", "atoms", *[rounded(F.col(a), 4).alias(a) for a in "xyz"])


@query(f"""WITH {ATOMS}, ca AS (SELECT split_part(protein_key, '_', 1) AS file, split_part(protein_key, '_', 2) AS chain_id, res_id FROM atoms WHERE n = 'CA'), c AS (SELECT file, count(DISTINCT chain_id) AS n FROM ca GROUP BY file),
p AS (SELECT file, arg_min(chain_id, (CASE WHEN chain_id = 'A' THEN 0 WHEN n = 1 THEN 2 ELSE 3 END, chain_id)) AS chain_id FROM ca JOIN c USING (file) GROUP BY file)
SELECT file, chain_id, count(*) AS atoms, min(res_id) AS first, max(res_id) AS last FROM ca JOIN p USING (file, chain_id) GROUP BY ALL""")
def alpha_carbon_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Alpha carbons of each file's chain A, else of its only chain, else of its first."""
    atoms = parsed_atoms(spark, sf).withColumn("file", F.substring_index("protein_key", "_", 1))
    return structures.alpha_carbons(atoms, "file", F.lit("A")).groupBy("file", "chain_id").agg(F.count("*").alias("atoms"), F.min("residue_number").alias("first"), F.max("residue_number").alias("last"))


@query(f"""WITH {ATOMS} SELECT n AS element, count(*) AS atoms FROM (SELECT substr(n, 1, 1) AS n FROM atoms WHERE res NOT IN ({", ".join(f"'{s}'" for s in structures.SOLVENTS)})) GROUP BY n""")
def heavy_atom_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Atoms of a surface by element."""
    return structures.heavy_atoms(parsed_atoms(spark, sf)).groupBy("element").agg(F.count("*").alias("atoms"))


@query("SELECT trim(protein_id) AS entry, min(row_id) AS place FROM train_ids WHERE protein_id IS NOT NULL AND trim(protein_id) <> '' GROUP BY 1")
def list_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a list between comments and settings, at their first place."""
    lines = table(spark, sf, "train_ids").where("protein_id IS NOT NULL").select("row_id", F.explode(F.array(F.lit("# comment"), F.lit(" PARAM.X=1"), F.lit("  "), F.col("protein_id"))).alias("line"))
    return files.dataset_list(lines, "line", "row_id")


FEATURES = ("file_name", "x", "y", "z", "chain_id", "residue_number", "residue_name", "label")


@query("""WITH s AS (SELECT DISTINCT point_id, point_idx, file_name, x, chain_id FROM sas_points WHERE file_name IS NOT NULL AND x IS NOT NULL AND NOT isnan(x))
SELECT file_name, count(*) AS points, min(point_id) AS first, round(avg(x), 4) AS x FROM s WHERE chain_id IS NULL OR trim(chain_id) = '' OR upper(trim(chain_id)) = 'A' GROUP BY file_name""")
def feature_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Points written as feature files and read back: chain A and rows without a chain, files in order of their first row."""
    rows = table(spark, sf, "sas_points").where("file_name IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)").select("point_id", "point_idx", *FEATURES).dropDuplicates(["point_id"])
    path = keep(spark, "features")
    sinks.feature_file(rows, path, ("point_id", *FEATURES))
    read = files.feature_csv(spark, path, "A")
    if not files.has_features(read, list(FEATURES)):
        raise ValueError("the file lacks columns")
    return read.groupBy("file_name").agg(F.count("*").alias("points"), F.min(F.col("point_id").cast("long")).alias("first"), rounded(F.avg(F.col("x").cast("double")), 4).alias("x"))


@query("""WITH s AS (SELECT DISTINCT point_id, file_name, label, residue_name FROM sas_points) SELECT 'points' AS part, count(*) AS n, count(label) AS labelled, count(residue_name) AS named FROM s
UNION ALL SELECT 'bare', count(*), 0, count(residue_name) FROM s""")
def feature_union(spark: SparkSession, sf: str) -> DataFrame:
    """Feature files of which one lacks a column as one table; a file without the needed columns is left out."""
    rows = table(spark, sf, "sas_points").select("point_id", "file_name", "label", "residue_name").dropDuplicates(["point_id"])
    parts = [rows.withColumn("part", F.lit("points")), rows.drop("label").withColumn("part", F.lit("bare")), rows.select("point_id").withColumn("part", F.lit("broken"))]
    return sinks.union_features(parts, ["part", "file_name", "residue_name"]).groupBy("part").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.count("residue_name").alias("named"))


@query("""WITH s AS (SELECT DISTINCT ON (sample_id) sample_id, split, protein_key, neighbor_idx, tabular FROM sample_store)
SELECT CAST(split AS INT) AS split, count(*) AS samples, count(DISTINCT protein_key) AS proteins, max(len(neighbor_idx)) AS k, max(len(tabular)) AS features FROM s GROUP BY split""")
def store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Samples written by split and read back, with what the store's attributes tell."""
    path = keep(spark, "store")
    sinks.sample_store(table(spark, sf, "sample_store").dropDuplicates(["sample_id"]), path)
    read = spark.read.parquet(path)
    return read.groupBy(F.col("split").cast("int").alias("split")).agg(F.count("*").alias("samples"), F.countDistinct("protein_key").alias("proteins"), F.max(F.size("neighbor_idx")).cast("long").alias("k"), F.max(F.size("tabular")).cast("long").alias("features"))


@query("""WITH s AS (SELECT DISTINCT ON (sample_id) sample_id, lower(protein_key) AS k FROM sample_store), c AS (SELECT *, CASE WHEN k IS NOT DISTINCT FROM lag(k) OVER (ORDER BY sample_id) AND row_number() OVER (ORDER BY sample_id) > 1 THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (ORDER BY sample_id) AS run FROM c), r AS (SELECT k, min(sample_id) AS first, max(sample_id) AS last, count(*) AS n FROM i GROUP BY k, run)
SELECT k AS protein, max(first) AS first, arg_max(last, first) AS last, arg_max(n, first) AS n FROM r GROUP BY k""")
def range_index(spark: SparkSession, sf: str) -> DataFrame:
    """Each protein's last run of samples."""
    rows = table(spark, sf, "sample_store").dropDuplicates(["sample_id"]).select("sample_id", F.lower("protein_key").alias("protein"))
    return files.last_runs(rows, "protein", "sample_id")


@query(f"""WITH s AS (SELECT DISTINCT ON (sample_id) sample_id, lower(protein_key) AS k, label FROM sample_store), w AS (SELECT DISTINCT {entry_code_sql('protein_id')} AS e FROM test_ids)
SELECT k AS protein, count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives FROM s WHERE {entry_code_sql('k')} IN (SELECT e FROM w WHERE e IS NOT NULL) GROUP BY k""")
def truth_load(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the proteins that a list asks for."""
    wanted = table(spark, sf, "test_ids").select(entry_code(F.col("protein_id")).alias("e")).where("e IS NOT NULL").distinct()
    rows = table(spark, sf, "sample_store").dropDuplicates(["sample_id"]).select(F.lower("protein_key").alias("protein"), "label").withColumn("e", entry_code(F.col("protein")))
    return rows.join(wanted, "e", "left_semi").groupBy("protein").agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == 1, 1)).alias("positives"))


@query("""WITH w AS (SELECT DISTINCT protein_key AS k FROM sas_points), f AS (SELECT DISTINCT trim(protein_key) AS f FROM proteins WHERE protein_key IS NOT NULL),
m AS (SELECT k, 1 AS class, f FROM w JOIN f ON f = k UNION ALL SELECT k, 2, f FROM w JOIN f ON f = lower(k) UNION ALL SELECT k, 3, f FROM w JOIN f ON f = upper(k) UNION ALL SELECT k, 4, f FROM w JOIN f ON split_part(f, '_', 1) = split_part(k, '_', 1))
SELECT w.k AS protein_key, CAST(min(class) AS INT) AS class, arg_min(f, (class, f)) AS file FROM w LEFT JOIN m ON w.k = m.k GROUP BY w.k""")
def embedding_files(spark: SparkSession, sf: str) -> DataFrame:
    """The file of each chain: its own name, in lower case, in upper case, else the least that begins with its entry."""
    wanted = table(spark, sf, "sas_points").select("protein_key").distinct()
    named = table(spark, sf, "proteins").select(F.trim("protein_key").alias("file")).where("file IS NOT NULL").distinct()
    token = lambda c: F.substring_index(c, "_", 1)
    match = lambda a, b, c: wanted.select("protein_key", a.alias("_k")).join(named.select("file", b.alias("_k")), "_k").select("protein_key", F.struct(F.lit(c).alias("class"), "file").alias("m"))
    key, f = F.col("protein_key"), F.col("file")
    every = match(key, f, 1).union(match(F.lower(key), f, 2)).union(match(F.upper(key), f, 3)).union(match(token(key), token(f), 4))
    best = every.groupBy("protein_key").agg(F.min("m").alias("b"))
    return wanted.join(best, "protein_key", "left").select("protein_key", "b.class", "b.file")


AP_TEXT = ["atomName, apRawValids, atomicHydrophobicity", "ALA.CA, 0.627, -1", "GLY.CA,  0.71 ,1", "LYS.NZ, x, 1", "SER.OG, 1.2,"]


@query("SELECT * FROM (VALUES ('ALA.CA', CAST(0.627 AS DOUBLE), CAST(-1 AS DOUBLE)), ('GLY.CA', 0.71, 1), ('SER.OG', 1.2, NULL)) t(\"atomName\", \"apRawValids\", \"atomicHydrophobicity\")")
def property_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A table of atoms with blanks behind its commas; a row without its value is left out."""
    path = keep(spark, "atoms")
    spark.createDataFrame([(line,) for line in AP_TEXT], "line string").coalesce(1).write.text(path)
    return files.property_table(spark, path).where(F.col("apRawValids").isNotNull())


@query(f"""WITH {PTS}, s AS (SELECT DISTINCT protein_key, residue_number % 4 AS pocket_id, chain_id, residue_number FROM pts WHERE label = 1 AND chain_id IS NOT NULL AND trim(chain_id) <> '' AND residue_number >= 0)
SELECT protein_key AS protein_id, pocket_id, count(*) AS residues FROM s GROUP BY ALL""")
def site_text_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Sites as lines of protein, site, chain and residue between comments, read back."""
    rows = points(spark, sf).where("label = 1 AND chain_id IS NOT NULL AND trim(chain_id) <> '' AND residue_number >= 0")
    text = F.concat_ws(" ", "protein_key", (F.col("residue_number") % 4).cast("string"), "chain_id", F.col("residue_number").cast("string"))
    lines = rows.select(F.explode(F.array(F.lit("# a comment line here"), text, F.lit("short line"))).alias("line"))
    return files.site_text(lines).select("protein_id", "pocket_id", F.size("residues").cast("long").alias("residues"))


@query(f"WITH {SCORED} SELECT count(*) AS n, round(avg(1/(1+exp(-(6.5*least(1, greatest(0, p))-3.25)))), 6) AS calibrated FROM scored")
def calibration_file(spark: SparkSession, sf: str) -> DataFrame:
    """Platt's a and b from a file of settings, applied."""
    path = keep(spark, "platt")
    spark.createDataFrame([('{"type": "platt", "a": 6.5, "b": -3.25}',)], "j string").coalesce(1).write.text(path)
    a, b = files.platt_settings(spark, path)
    return scored(spark, sf).agg(F.count("*").alias("n"), rounded(F.avg(X.platt(F.col("p"), a, b)), 6).alias("calibrated"))


@query("SELECT protein_no FROM (SELECT DISTINCT protein_no FROM proteins) WHERE protein_no % 7 = 3")
def index_file(spark: SparkSession, sf: str) -> DataFrame:
    """Indices out of a file of settings."""
    path = keep(spark, "indices")
    listed = table(spark, sf, "proteins").where("protein_no % 7 = 3").select("protein_no").distinct()
    # a file for each of many parts, so no task holds all indices
    listed.groupBy((F.col("protein_no") % 64).alias("part")).agg(F.sort_array(F.collect_list("protein_no")).alias("indices")).select("part", F.to_json(F.struct("indices")).alias("j")).write.partitionBy("part").text(path)
    return files.index_payload(spark, path).select(F.col("index").alias("protein_no"))


@query("""WITH n AS (SELECT DISTINCT 'epoch=' || CAST(protein_no AS VARCHAR) || '-auprc=' || printf('%.4f', (protein_no * 37 % 9973) / 10000.0) || '.ckpt' AS name, (protein_no * 37 % 9973) / 10000.0 AS v FROM proteins)
SELECT name, CAST(printf('%.4f', v) AS DOUBLE) AS auprc FROM n ORDER BY CAST(printf('%.4f', v) AS DOUBLE) DESC, name LIMIT 1""")
def checkpoint_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The checkpoint whose name tells the largest metric."""
    name = F.concat(F.lit("epoch="), F.col("protein_no").cast("string"), F.lit("-auprc="), F.format_string("%.4f", (F.col("protein_no") * 37 % 9973) / F.lit(10000.0)), F.lit(".ckpt"))
    return files.best_checkpoint(table(spark, sf, "proteins").select(name.alias("name")).distinct())


@query("SELECT protein_key AS path FROM proteins WHERE registered_at IS NOT NULL AND protein_key IS NOT NULL ORDER BY registered_at DESC, protein_key DESC LIMIT 1")
def newest_path(spark: SparkSession, sf: str) -> DataFrame:
    """The folder that changed last."""
    return files.newest(table(spark, sf, "proteins").where("registered_at IS NOT NULL AND protein_key IS NOT NULL").select(F.col("protein_key").alias("path"), F.col("registered_at").alias("mtime")))


@query(f"""{BASE}, p AS (SELECT protein_key, count(*) AS pockets, max(sample_points) AS largest FROM ranked GROUP BY protein_key) SELECT '{{"largest":' || CAST(largest AS VARCHAR) || ',"pockets":' || CAST(pockets AS VARCHAR) || ',"protein_key":"' || protein_key || '"}}' AS json FROM p""")
def summary_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each protein's summary as JSON, keys sorted."""
    return sinks.summary_json(pockets(spark, sf).ranked.groupBy("protein_key").agg(F.count("*").alias("pockets"), F.max("sample_points").alias("largest")))


@query(f"""{BASE} SELECT protein_key, string_agg(printf('pseudoatom pocket%d, pos=[%.3f, %.3f, %.3f]', rank, cx + 1e-9, cy + 1e-9, cz + 1e-9), chr(10) ORDER BY rank) AS script FROM ranked GROUP BY protein_key""")
def view_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """A viewer's script of each protein's pocket centres."""
    return sinks.view_script(pockets(spark, sf).ranked.select("protein_key", "rank", *[(F.col(f"c{a}") + 1e-9).alias(f"c{a}") for a in "xyz"]))


@query("""WITH n AS (SELECT DISTINCT protein_no, split_part(trim(protein_key), '_', 1) || '_' || lower(right(trim(protein_key), 1)) || '_' || CASE WHEN protein_no % 3 = 0 THEN 'B' ELSE upper(right(trim(protein_key), 1)) END AS name FROM proteins WHERE contains(protein_key, '_'))
SELECT name, CASE WHEN regexp_matches(name, '_[A-Za-z]_[A-Za-z]$') AND lower(name[-1:]) = lower(name[-3:-3]) THEN name[:-5] || '_' || name[-1:] ELSE name END AS repaired FROM (SELECT DISTINCT name FROM n)""")
def embedding_renames(spark: SparkSession, sf: str) -> DataFrame:
    """Names whose chain stands twice, repaired."""
    key = F.trim("protein_key")
    chain = F.right(key, F.lit(1))
    name = F.concat(F.substring_index(key, "_", 1), F.lit("_"), F.lower(chain), F.lit("_"), F.when(F.col("protein_no") % 3 == 0, "B").otherwise(F.upper(chain)))
    return table(spark, sf, "proteins").where(F.col("protein_key").contains("_")).select(name.alias("name")).distinct().select("name", X.repair_embedding_name(F.col("name")).alias("repaired"))


@query("""WITH s AS (SELECT DISTINCT ON (sample_id) sample_id, protein_key, residue_number, label FROM sample_store)
SELECT sample_id, lower(split_part(protein_key, '_', 1)) || '_' || upper(split_part(protein_key, '_', 2)) AS key, coalesce(CAST(label AS INT), CASE WHEN residue_number > 100 THEN 1 ELSE 0 END, 0) AS label FROM s""")
def keys_and_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Protein keys built from their parts, and labels with what stands in for missing ones."""
    rows = table(spark, sf, "sample_store").dropDuplicates(["sample_id"])
    parts = F.split("protein_key", "_")
    return rows.select("sample_id", X.protein_key(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("key"), X.label_of(F.col("label"), F.col("residue_number") - 100).alias("label"))


@query("""WITH p AS (SELECT DISTINCT pocket_id, protein_key, CAST(rank AS INT) AS rank, proba_tp FROM pockets WHERE proba_tp IS NOT NULL AND NOT isnan(proba_tp) AND rank IS NOT NULL),
l AS (SELECT protein_key, rank, ln(greatest(least(proba_tp, 1 - 1e-6), 1e-6) / (1 - greatest(least(proba_tp, 1 - 1e-6), 1e-6))) AS l FROM p)
SELECT protein_key, rank, count(*) AS seeds, round(1 / (1 + exp(-avg(l) / 1.5)), 6) AS probability, round(avg(sign(l) * abs(l) ** 2), 4) AS power FROM l GROUP BY ALL""")
def logit_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities of several seeds by the mean of their logits over a temperature of 1.5, and a signed power of them."""
    rows = table(spark, sf, "pockets").where("proba_tp IS NOT NULL AND NOT isnan(proba_tp) AND rank IS NOT NULL").select("pocket_id", "protein_key", "rank", "proba_tp").distinct()
    logit = X.logit(F.col("proba_tp"))
    return rows.groupBy("protein_key", "rank").agg(F.count("*").alias("seeds"), rounded(X.sigmoid(F.avg(logit) / 1.5), 6).alias("probability"), rounded(F.avg(X.power_feature(logit, 2.0, True)), 4).alias("power"))


def _weights(rows: int, columns: int, seed: int) -> np.ndarray:
    return (np.arange(rows)[:, None] * 7 + np.arange(columns) * 3 + seed) % 11 / 50 - 0.1


W1, W2 = _weights(35, 3, 1), _weights(3, 1, 4)
B1 = np.array([0.05, -0.02, 0.1])
_HIDDEN = ", ".join(f"greatest(0.0, list_dot_product(t, {[float(v) for v in W1[:, j]]}::DOUBLE[]) + {B1[j]})" for j in range(3))


@query(f"""WITH s AS (SELECT DISTINCT ON (sample_id) sample_id, [CASE WHEN v IS NULL OR isnan(v) THEN 0.0 ELSE CAST(v AS DOUBLE) END for v in tabular] AS t FROM sample_store WHERE tabular IS NOT NULL AND len(tabular) = 35)
SELECT sample_id, round(1 / (1 + exp(-list_dot_product([{_HIDDEN}], {[float(v) for v in W2[:, 0]]}::DOUBLE[]) + 0.03)), 5) AS score FROM s""")
def perceptron_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A perceptron of one hidden layer over each sample's descriptors, batch by batch."""
    rows = table(spark, sf, "sample_store").where("tabular IS NOT NULL AND size(tabular) = 35").dropDuplicates(["sample_id"])
    net = scoring.perceptron([(W1, B1), (W2, np.array([-0.03]))])
    return scoring.score_batches(rows, "sample_id", "tabular", net).select("sample_id", rounded(F.col("score"), 5).alias("score"))


NEAR = f"""s AS (SELECT DISTINCT ON (sample_id) sample_id, lower(split_part(protein_key, '_', 1)) || '_' || upper(split_part(protein_key, '_', 2)) AS k, point_idx, neighbor_idx, neighbor_distances FROM sample_store WHERE len(neighbor_idx) = len(neighbor_distances)),
one AS (SELECT protein_key, point_idx, min(point_id) AS point_id FROM pts GROUP BY ALL), v AS (SELECT pts.* FROM pts JOIN one USING (protein_key, point_idx, point_id)),
c AS (SELECT sample_id, k, neighbor_idx, neighbor_distances, v.x/50 AS x, v.y/50 AS y, v.z/50 AS z, v.prob FROM s JOIN v ON v.protein_key = k AND v.point_idx = s.point_idx),
n AS (SELECT sample_id, k, x, y, z, unnest(neighbor_idx) AS i, CAST(unnest(neighbor_distances) AS DOUBLE) AS d FROM c),
l AS (SELECT n.sample_id, v.x/50 AS ax, v.y/50 AS ay, v.z/50 AS az, (n.x*v.x/50 + n.y*v.y/50 + n.z*v.z/50) / sqrt(3) - d AS logit FROM n JOIN v ON v.protein_key = n.k AND v.point_idx = n.i WHERE NOT isnan(d) AND d < 900),
t AS (SELECT sample_id, max(logit) AS top FROM l GROUP BY sample_id), w AS (SELECT l.sample_id, sum(exp(logit-top)) AS s, sum(exp(logit-top)*ax) AS x, sum(exp(logit-top)*ay) AS y, sum(exp(logit-top)*az) AS z FROM l JOIN t USING (sample_id) GROUP BY l.sample_id)"""


@query(f"""WITH {PTS}, {NEAR}, g AS (SELECT c.sample_id, 1/(1+exp(-(2*c.prob-1))) AS g, c.x, c.y, c.z, coalesce(w.x/s, c.x) AS wx, coalesce(w.y/s, c.y) AS wy, coalesce(w.z/s, c.z) AS wz FROM c LEFT JOIN w ON w.sample_id = c.sample_id)
SELECT sample_id, round(g*x + (1-g)*wx, 5) AS x, round(g*y + (1-g)*wy, 5) AS y, round(g*z + (1-g)*wz, 5) AS z FROM g""")
def neighbour_attention(spark: SparkSession, sf: str) -> DataFrame:
    """Each sample's vector blended, by a gate from its probability, with the distance-biased attention over its stored neighbours."""
    parts = F.split("protein_key", "_")
    key = X.protein_key(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    one = points(spark, sf).groupBy("protein_key", "point_idx").agg(F.min(F.struct("point_id", "x", "y", "z", "prob")).alias("p")).select("protein_key", "point_idx", F.array(*[F.col(f"p.{a}") / 50 for a in "xyz"]).alias("v"), "p.prob")
    one = materialize(one, "vectors")
    s = table(spark, sf, "sample_store").where("size(neighbor_idx) = size(neighbor_distances)").dropDuplicates(["sample_id"]).select("sample_id", key.alias("protein_key"), "point_idx", F.arrays_zip("neighbor_idx", "neighbor_distances").alias("n"))
    centre = materialize(s.join(one, ["protein_key", "point_idx"]), "centres")
    listed = centre.select("sample_id", "protein_key", F.explode("n").alias("n")).select("sample_id", "protein_key", F.col("n.neighbor_idx").alias("point_idx"), F.col("n.neighbor_distances").cast("double").alias("d"))
    around = listed.join(one.select("protein_key", "point_idx", F.col("v").alias("a")), ["protein_key", "point_idx"]).groupBy("sample_id").agg(F.collect_list(F.struct("a", "d")).alias("n"))
    rows = centre.select("sample_id", "v", "prob").join(around, "sample_id", "left").select("sample_id", "v", "prob", F.col("n.a").alias("a"), F.col("n.d").alias("d"))

    def run(batches):
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), float).reshape(-1, 3)
            a, d = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            k = max([len(x) for x in d if x] or [1])
            vectors, distance = np.zeros((len(v), k, 3)), np.full((len(v), k), np.inf)
            for j, (x, y) in enumerate(zip(a, d)):
                if y:
                    vectors[j, : len(y)], distance[j, : len(y)] = x, y
            context = scoring.attend(v, vectors, distance, 1.0, 900.0)
            out = scoring.blend(v, context, 2 * batch.column(2).to_numpy() - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[:, j]) for j in range(3)]], names=["sample_id", "x", "y", "z"])

    return rows.mapInArrow(run, "sample_id long, x double, y double, z double").select("sample_id", *[rounded(F.col(c), 5).alias(c) for c in "xyz"])


@query("""WITH p AS (SELECT DISTINCT pocket_id, seed_no, score FROM pockets WHERE score IS NOT NULL AND NOT isnan(score)) SELECT seed_no, round(avg(score), 6) AS score FROM p GROUP BY seed_no ORDER BY avg(score) DESC, seed_no LIMIT 3""")
def top_models(spark: SparkSession, sf: str) -> DataFrame:
    """The three seeds of the largest mean score."""
    rows = table(spark, sf, "pockets").where("score IS NOT NULL AND NOT isnan(score)").select("pocket_id", "seed_no", "score").distinct()
    return rows.groupBy("seed_no").agg(F.avg("score").alias("m")).orderBy(F.desc("m"), "seed_no").limit(3).select("seed_no", rounded(F.col("m"), 6).alias("score"))


@query(f"{BASE} SELECT protein_key, cluster_id, rank, members FROM ranked WHERE members > 0 AND rank <= 2")
def shown_pockets(spark: SparkSession, sf: str) -> DataFrame:
    """The first two pockets of a protein that have members, for display."""
    return pockets(spark, sf).ranked.where("members > 0 AND rank <= 2").select("protein_key", "cluster_id", "rank", "members")


@query("SELECT protein_key, count(DISTINCT seed_no) AS seeds, min(seed_no) AS first FROM pockets WHERE protein_key IS NOT NULL GROUP BY protein_key")
def seed_union(spark: SparkSession, sf: str) -> DataFrame:
    """Proteins of any seed, with how many have it."""
    return table(spark, sf, "pockets").where("protein_key IS NOT NULL").groupBy("protein_key").agg(F.countDistinct("seed_no").alias("seeds"), F.min("seed_no").alias("first"))


@query(f"""WITH {PTS}, b AS (SELECT protein_key, point_id, row_number() OVER (PARTITION BY protein_key ORDER BY md5('3:' || CAST(point_id AS VARCHAR)), point_id) AS r FROM pts WHERE coalesce(label, 0) = 0) SELECT protein_key, point_id FROM b WHERE r <= 40""")
def background_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Forty unlabelled points of each protein for display, the same on every run."""
    rows = points(spark, sf).where("coalesce(label, 0) = 0").select("protein_key", "point_id", sampling.hash_rank(F.col("point_id"), 3).alias("h"))
    order = Window.partitionBy("protein_key").orderBy("h", "point_id")  # Spark keeps the first forty of a group before the shuffle
    return rows.withColumn("r", F.row_number().over(order)).where("r <= 40").select("protein_key", "point_id")


@query(f"""WITH e AS (SELECT DISTINCT row_id, {STEM} AS name FROM val_ids WHERE protein_id IS NOT NULL), f AS (SELECT DISTINCT 'data/' || trim(protein_key) AS path FROM proteins WHERE protein_key IS NOT NULL UNION SELECT DISTINCT 'old/' || lower(split_part(trim(protein_key), '_', 1)) FROM proteins WHERE protein_key IS NOT NULL),
c AS (SELECT row_id, 0 AS p, 'data/' || name AS path FROM e UNION ALL SELECT row_id, 1, 'data/' || lower(name) FROM e UNION ALL SELECT row_id, 2, 'old/' || lower(split_part(name, '_', 1)) FROM e)
SELECT e.row_id, arg_min(c.path, c.p) AS path FROM e LEFT JOIN (SELECT c.* FROM c JOIN f ON c.path = f.path) c ON c.row_id = e.row_id GROUP BY e.row_id""")
def path_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """The first path that exists of those that an id may have."""
    wanted = table(spark, sf, "val_ids").where("protein_id IS NOT NULL").select("row_id", X.stem(F.col("protein_id")).alias("name"))
    key = table(spark, sf, "proteins").where("protein_key IS NOT NULL").select(F.trim("protein_key").alias("k"))
    existing = key.select(F.concat(F.lit("data/"), "k").alias("path")).union(key.select(F.concat(F.lit("old/"), F.lower(F.substring_index("k", "_", 1)))))
    name = F.col("name")
    return files.resolve(wanted, "row_id", [F.concat(F.lit("data/"), name), F.concat(F.lit("data/"), F.lower(name)), F.concat(F.lit("old/"), F.lower(F.substring_index(name, "_", 1)))], existing, "path")


@query(f"""WITH e AS (SELECT DISTINCT {entry_code_sql('protein_id')} AS e FROM val_ids), k AS (SELECT DISTINCT protein_key AS k FROM sas_points) SELECT e AS entry, k AS protein_key FROM e JOIN k ON contains(k, e) WHERE e IS NOT NULL""")
def substring_join(spark: SparkSession, sf: str) -> DataFrame:
    """Entries with the keys that hold them anywhere: an equi-join on the keys' substrings of four to eight signs."""
    entries = table(spark, sf, "val_ids").select(entry_code(F.col("protein_id")).alias("entry")).where("entry IS NOT NULL").distinct()
    keys = table(spark, sf, "sas_points").select("protein_key").distinct()
    return keys.select("protein_key", F.explode(files.substrings(F.col("protein_key"), 4, 8)).alias("entry")).join(entries, "entry").select("entry", "protein_key")


@query(f"""WITH {RES}, t AS (SELECT DISTINCT lower(split_part(protein_key, '_', 1)) || '_' || upper(split_part(protein_key, '_', 2)) AS protein_key, residue_number AS wanted FROM sample_store WHERE residue_number IS NOT NULL)
SELECT t.protein_key, wanted, arg_min(res_id, (abs(res_id - wanted), res_id)) AS taken FROM t JOIN (SELECT DISTINCT protein_key, res_id FROM res WHERE res_id IS NOT NULL) r ON r.protein_key = t.protein_key GROUP BY t.protein_key, wanted""")
def closest_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """For each residue that is asked for the one of its number, else the closest, the lower of equals."""
    part = lambda k: F.split_part(F.col("protein_key"), F.lit("_"), F.lit(k))
    key = X.protein_key(part(1), part(2))
    wanted = table(spark, sf, "sample_store").where("residue_number IS NOT NULL").select(key.alias("protein_key"), F.col("residue_number").alias("n"))
    have = residues(spark, sf).where("res_id IS NOT NULL").select("protein_key", F.col("res_id").alias("n"))
    return closest(wanted, have)


#: Residue numbers that are ordered in one task at most.
STRETCH = 1 << 14


def closest(wanted: DataFrame, have: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``protein_key, wanted, taken`` of two tables of ``protein_key, n``.

    A protein is cut into stretches of numbers. Each stretch gets the last
    number that its protein has before it and the first one behind it as rows
    of its own, so it can be ordered without the others. All frames begin at
    the first row: one that reaches to the last is read anew for every row.
    """
    rows = lambda df, asked: df.where("protein_key IS NOT NULL").distinct().withColumn("asked", F.lit(asked))
    both = rows(wanted, True).unionByName(rows(have, False)).withColumn("at", F.floor(F.col("n") / stretch))
    own = F.when(~F.col("asked"), F.col("n"))
    ends = both.groupBy("protein_key", "at").agg(F.min(own).alias("low"), F.max(own).alias("high"))
    up, down = Window.partitionBy("protein_key").orderBy("at"), Window.partitionBy("protein_key").orderBy(F.desc("at"))
    outside = lambda name, w: F.last(name, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    beyond = ends.withColumn("b", outside("high", up)).withColumn("a", outside("low", down))
    carried = beyond.select("protein_key", "at", F.explode(F.array("b", "a")).alias("n")).where("n IS NOT NULL")
    every = both.unionByName(carried.withColumn("asked", F.lit(False))).withColumn("own", own)
    here = Window.partitionBy("protein_key", "at")
    near = lambda *order: F.last("own", True).over(here.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    told = every.withColumn("b", near("n", "asked")).withColumn("a", near(F.desc("n"), "asked")).where("asked AND (a IS NOT NULL OR b IS NOT NULL)")
    n, a, b = (F.col(c).cast("long") for c in "nab")
    low = F.col("a").isNull() | (F.col("b").isNotNull() & (n - b <= a - n))
    return told.select("protein_key", F.col("n").alias("wanted"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("taken"))


@query(f"""WITH {SCORED}, {PTS}, auc AS (SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM scored GROUP BY p), st AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM auc)
SELECT (SELECT round(sum(pos*tp/(tp+fp))/sum(pos), 6) FROM st) AS auprc, (SELECT round(sum(neg*(tp-pos/2))/(sum(pos)*sum(neg)), 6) FROM st) AS auroc, (SELECT round(avg(CASE WHEN u = 0 THEN 1.0 ELSE i/u END), 6) FROM (SELECT count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS i, count(*) FILTER (WHERE p >= 0.5 OR y = 1) AS u FROM scored GROUP BY protein_key)) AS mean_iou,
  (SELECT count(DISTINCT protein_key) FROM scored) AS proteins, (SELECT count(*) FROM scored) AS points, (SELECT count(*) FROM scored WHERE y = 1) AS positives""")
def scored_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """The point-level half of the comprehensive evaluation in one record."""
    rows = materialize(scored(spark, sf), "scored")
    steps = M.score_steps(rows)
    on, pos = F.col("p") >= 0.5, F.col("y") == 1
    per = rows.groupBy("protein_key").agg(F.count(F.when(on & pos, 1)).alias("i"), F.count(F.when(on | pos, 1)).alias("u"))
    parts = [
        steps.agg(rounded(M.average_precision(steps), 6).alias("auprc"), rounded(M.auroc(steps), 6).alias("auroc"), F.sum("pos").alias("positives"), (F.sum("pos") + F.sum("neg")).alias("points")),
        per.agg(rounded(F.avg(F.when(F.col("u") == 0, 1.0).otherwise(F.col("i") / F.col("u"))), 6).alias("mean_iou"), F.count("*").alias("proteins")),
    ]
    return parts[0].withColumn("k", F.lit(1)).join(parts[1].withColumn("k", F.lit(1)), "k").drop("k")


@query(f"""{BOTH}, o AS (SELECT grown.protein_key, cluster_id, count(*) AS n, count(*) FILTER (WHERE pts.label = 1) AS hit FROM grown JOIN pts ON pts.point_id = grown.point_id GROUP BY ALL), lab AS (SELECT DISTINCT protein_key FROM pts WHERE label = 1)
SELECT count(*) AS pockets, (SELECT count(DISTINCT protein_key) FROM ranked) AS with_pockets, round((SELECT count(DISTINCT protein_key) FROM ranked) / (SELECT count(DISTINCT protein_key) FROM pts), 6) AS coverage, round(avg(hit/n) FILTER (WHERE protein_key IN (SELECT protein_key FROM lab)), 6) AS mean_overlap, round(stddev_pop(hit/n) FILTER (WHERE protein_key IN (SELECT protein_key FROM lab)), 6) AS std_overlap FROM o""")
def pocket_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """The pocket-level half: pockets, the share of proteins that have one, and how much of a pocket is labelled in proteins with labels."""
    made = pockets(spark, sf)
    lab = made.points.where("label = 1").select("protein_key").distinct().withColumn("labelled", F.lit(True))
    o = made.grown.join(made.points.select("point_id", "label"), "point_id").groupBy("protein_key", "cluster_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == 1, 1)).alias("hit"))
    share = F.when(F.col("labelled"), F.col("hit") / F.col("n"))
    sums = o.join(lab, "protein_key", "left").agg(F.count("*").alias("pockets"), F.countDistinct("protein_key").alias("with_pockets"), rounded(F.avg(share), 6).alias("mean_overlap"), rounded(F.stddev_pop(share), 6).alias("std_overlap"))
    every = made.points.agg(F.countDistinct("protein_key").alias("every"))
    return sums.withColumn("k", F.lit(1)).join(every.withColumn("k", F.lit(1)), "k").select("pockets", "with_pockets", rounded(F.col("with_pockets") / F.col("every"), 6).alias("coverage"), "mean_overlap", "std_overlap")


DIMS = ("hydropathy", *[c for c in ("hydrophobic", "hydrophilic", "aromatic", "h_donor", "h_acceptor", "polar", "ionizable")])


@query("""WITH p AS (SELECT DISTINCT point_id, protein_key, CASE WHEN upper(trim(residue_name)) IN ('MSE') THEN 'MET' WHEN upper(trim(residue_name)) = 'SEC' THEN 'CYS' WHEN upper(trim(residue_name)) = 'PYL' THEN 'LYS' ELSE upper(trim(residue_name)) END AS r FROM sas_points)
SELECT protein_key, round(avg(CASE WHEN r IN ('ALA','CYS','ILE','LEU','MET','PHE','PRO','TRP','VAL') THEN 1.0 WHEN r IN ('GLY','TYR') THEN 0.5 WHEN r = 'HEM' THEN 0.3 ELSE 0 END), 6) AS hydrophobic,
  round(avg(CASE WHEN r IN ('ARG','ASN','ASP','CYS','GLN','GLU','HIS','LYS','SER','THR','TYR','HEM') THEN 1.0 WHEN r = 'TRP' THEN 0.5 ELSE 0 END), 6) AS polar, round(avg(CASE WHEN r IN ('ARG','ASP','GLU','HIS','LYS') THEN 1.0 WHEN r IN ('CYS','TYR') THEN 0.5 ELSE 0 END), 6) AS ionizable FROM p GROUP BY protein_key""")
def graded_chemistry(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the second residue dimension over a protein's points."""
    from voxelmill.functions import chemistry

    rows = table(spark, sf, "sas_points").select("point_id", "protein_key", "residue_name").dropDuplicates(["point_id"])
    return chemistry.with_graded(rows).groupBy("protein_key").agg(*[rounded(F.avg(c), 6).alias(c) for c in ("hydrophobic", "polar", "ionizable")])
