"""Fixed-width structure text: atoms, ligands, alpha carbons and residue sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# fixed values: residue names that are no ligands
SOLVENTS = ("HOH", "WAT", "H2O", "NA", "CL", "K", "MG", "CA", "ZN", "SO4", "PO4", "ACE", "NH2")
# fixed values: standard residues and their letters
LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line`` of text files."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def parse_atoms(lines: DataFrame, line: str = "line") -> DataFrame:
    """ATOM and HETATM records by their columns; the other columns of ``lines`` are kept.

    A blank occupancy or temperature factor is 0; a blank element is the first
    letter of the atom name, and elements are upper-case. Lines on which a
    number is none, the serial number too, are left out.
    """
    cut = lambda a, b: F.trim(F.substring(F.col(line), a + 1, b - a))
    number = lambda a, b: cut(a, b).try_cast("double")
    filled = lambda a, b: F.when(cut(a, b) == "", F.lit(0.0)).otherwise(number(a, b))
    atom, element = cut(12, 16), F.upper(cut(76, 78))
    rows = lines.where(F.substring(F.col(line), 1, 6).isin("ATOM  ", "HETATM")).select(
        *[c for c in lines.columns if c != line], cut(0, 6).alias("record"), cut(6, 11).try_cast("int").alias("atom_id"), atom.alias("atom_name"), cut(17, 20).alias("residue_name"),
        cut(21, 22).alias("chain_id"), cut(22, 26).try_cast("int").alias("residue_number"), number(30, 38).alias("x"), number(38, 46).alias("y"), number(46, 54).alias("z"),
        filled(54, 60).alias("occupancy"), filled(60, 66).alias("bfactor"), F.when(element == "", F.upper(F.substring(atom, 1, 1))).otherwise(element).alias("element"),
    )
    return rows.where(" AND ".join(f"{c} IS NOT NULL" for c in ("atom_id", "residue_number", "x", "y", "z", "occupancy", "bfactor")))


def record_line(record: str | Column, serial: Column, atom: Column, residue: Column, chain: Column, number: Column, place: tuple[Column, Column, Column], occupancy: Column | None = None, bfactor: Column | None = None, element: Column | None = None) -> Column:
    """A record as text, for sinks and round trips; serial numbers go on from 99999 to 0."""
    record = F.lit(record) if isinstance(record, str) else record
    left, right = (lambda c, n: F.rpad(c, n, " ")), (lambda c, n: F.lpad(c, n, " "))
    two = lambda c: F.lit(" " * 6) if c is None else right(F.format_string("%.2f", c), 6)
    return F.concat(
        left(record, 6), right((serial % 100_000).cast("string"), 5), F.lit(" "), left(F.concat(F.when(F.length(atom) < 4, " ").otherwise(""), atom), 4), F.lit(" "), right(residue, 3), F.lit(" "), left(chain, 1), right(number.cast("string"), 4), F.lit("    "),
        *[right(F.format_string("%.3f", v), 8) for v in place], two(occupancy), two(bfactor), F.lit(" " * 10), right(element if element is not None else F.lit(""), 2),
    )


def heavy_atoms(atoms: DataFrame, least_radius: float = 1.0, radius: str | None = None) -> DataFrame:
    """Atoms that make up a surface: no solvent, no hydrogen, and none whose radius, if there is one, is under 1."""
    rows = atoms.where(~F.col("residue_name").isin(*SOLVENTS) & (F.col("element") != "H"))
    return rows.where(F.col(radius) >= least_radius) if radius else rows


def ligands(atoms: DataFrame, by: list[str] = ()) -> DataFrame:
    """Groups of at least three HETATM records that are no solvent, with their centre."""
    keys = [*by, "chain_id", "residue_number", "residue_name"]
    rows = atoms.where((F.col("record") == "HETATM") & ~F.col("residue_name").isin(*SOLVENTS))
    return rows.groupBy(*keys).agg(F.count("*").alias("atoms"), *[F.avg(a).alias(a) for a in "xyz"]).where("atoms >= 3")


def alpha_carbons(atoms: DataFrame, by: str, chain: Column) -> DataFrame:
    """Alpha carbons of one chain per ``by``: the chain asked for, else a blank chain if A is asked, else the only chain, else the first."""
    ca = atoms.where("atom_name = 'CA'").withColumn("asked", chain)
    only = F.size(F.collect_set("chain_id").over(Window.partitionBy(by))) == 1
    choice = F.when(F.col("chain_id") == F.col("asked"), 0).when((F.col("chain_id") == "") & (F.col("asked") == "A"), 1).when(only, 2).otherwise(3)
    ranked = ca.withColumn("choice", choice)
    best = ranked.groupBy(by).agg(F.min(F.struct("choice", "chain_id")).alias("b")).select(by, F.col("b.chain_id").alias("chain_id"))
    return ranked.join(best, [by, "chain_id"], "left_semi").drop("choice", "asked")


def sequences(atoms: DataFrame, by: list[str]) -> DataFrame:
    """``sequence, numbers`` of standard residues with an alpha carbon, in order of their numbers."""
    letters = F.broadcast(atoms.sparkSession.createDataFrame(list(LETTERS.items()), "residue_name string, letter string"))
    ca = atoms.where("record = 'ATOM' AND atom_name = 'CA'").join(letters, "residue_name").groupBy(*by, "residue_number").agg(F.min("letter").alias("letter"))
    ordered = F.array_sort(F.collect_list(F.struct("residue_number", "letter")))
    return ca.groupBy(*by).agg(ordered.alias("s")).select(*by, F.concat_ws("", F.col("s.letter")).alias("sequence"), F.col("s.residue_number").alias("numbers"))
