"""Residue and atom chemistry as lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxelmill.functions.expressions import falloff, power_feature

# fixed values: hydropathy of residues
HYDROPATHY = {
    "ALA": 1.8, "ARG": -4.5, "ASN": -3.5, "ASP": -3.5, "CYS": 2.5, "GLN": -3.5, "GLU": -3.5, "GLY": -0.4, "HIS": -3.2, "ILE": 4.5,
    "LEU": 3.8, "LYS": -3.9, "MET": 1.9, "PHE": 2.8, "PRO": -1.6, "SER": -0.8, "THR": -0.7, "TRP": -0.9, "TYR": -1.3, "VAL": 4.2,
}
# fixed values: classes of residues; basic ones with their strength
CLASSES = {
    "hydrophobic": "PHE ILE TRP GLY LEU VAL MET ALA CYS TYR",
    "hydrophilic": "ARG ASN ASP GLN GLU LYS PRO",
    "aliphatic": "ALA LEU ILE VAL GLY PRO",
    "aromatic": "PHE TRP TYR",
    "sulfur": "CYS MET",
    "hydroxyl": "SER THR",
    "acidic": "ASP GLU",
    "amide": "ASN GLN",
    "pos_charge": "ARG HIS LYS",
    "neg_charge": "ASP GLU",
    "h_donor": "ARG LYS",  # TRP is missing here in the published table, and kept so
    "h_acceptor": "ASP GLU",
    "h_donor_acceptor": "ASN GLN HIS SER THR TYR",
    "polar": "ARG ASN ASP GLN GLU HIS LYS SER THR TYR CYS",
    "ionizable": "ASP GLU HIS LYS ARG CYS TYR",
}
BASIC = {"ARG": 3.0, "LYS": 2.0, "HIS": 1.0}
# fixed values: residues read as standard ones
STANDARD = {"MSE": "MET", "SEC": "CYS", "PYL": "LYS"}
# fixed values: pharmacophore flags by atom name and residues (None: all), first match holds
FLAGS = (
    ("hydrophobic", "C CA CB", None),
    ("hydrophobic", "CD", "ARG GLN GLU LYS PRO"),
    ("hydrophobic", "CD1", "ILE LEU"),
    ("aromatic", "CD1", "PHE TRP TYR"),
    ("hydrophobic", "CD2", "LEU"),
    ("aromatic", "CD2", "PHE TRP TYR HIS HID HIE"),
    ("hydrophobic", "CE", "LYS MET"),
    ("aromatic", "CE1", "HIS HID HIE PHE TYR"),
    ("aromatic", "CE2", "PHE TRP TYR"),
    ("aromatic", "CE3 CH2 CZ2 CZ3", "TRP"),
    ("hydrophobic", "CG", "ARG ASN ASP CYS CYX GLN GLU LEU LYS MET PRO"),
    ("aromatic", "CG", "HIS HID HIE PHE TRP TYR"),
    ("hydrophobic", "CG1", "ILE VAL"),
    ("hydrophobic", "CG2", "ILE THR VAL"),
    ("hydrophobic", "CZ", "ARG"),
    ("aromatic", "CZ", "PHE TYR"),
    ("donor", "N", None),
    ("donor acceptor", "ND1 NE2", "HIS HID HIE"),
    ("donor", "ND2", "ASN"),
    ("cation", "NE", "ARG LYS"),
    ("donor", "NE1", "TRP"),
    ("donor", "NE2", "GLN"),
    ("cation", "NH1 NH2", "ARG"),
    ("cation", "NZ", "LYS"),
    ("acceptor", "O", None),
    ("anion", "OD1 OD2", "ASP"),
    ("acceptor", "OD1", "ASN"),
    ("acceptor", "OE1", "GLN"),
    ("anion", "OE1 OE2", "GLU"),
    ("donor acceptor", "OG", "SER"),
    ("donor acceptor", "OG1", "THR"),
    ("donor acceptor", "OH", "TYR"),
    ("anion", "OXT", None),
    ("acceptor", "SD SG", "CYS CYX"),
    ("hydrophobic", "SD SG", "MET"),
    ("cation", "FE MG MN ZN CO", None),
)
FLAG_NAMES = ("aromatic", "cation", "anion", "hydrophobic", "acceptor", "donor")


def residue_properties(spark: SparkSession) -> DataFrame:
    """The residue dimension: 20 standard and three mapped residues, a column for each property."""
    rows = []
    for name in [*HYDROPATHY, *STANDARD]:
        own = STANDARD.get(name, name)
        rows.append((name, HYDROPATHY[own], BASIC.get(own, 0.0), *(float(own in v.split()) for v in CLASSES.values())))
    return spark.createDataFrame(rows, "residue_name string, hydropathy double, basic double, " + ", ".join(f"{c} double" for c in CLASSES))


def with_chemistry(df: DataFrame, residue: str = "residue_name") -> DataFrame:
    """Joins the residue dimension (23 rows); unknown residues have 0 everywhere."""
    dim = residue_properties(df.sparkSession).withColumnRenamed("residue_name", "_r")
    out = df.join(F.broadcast(dim), F.upper(F.trim(residue)) == F.col("_r"), "left").drop("_r")
    return out.fillna(0.0, [c for c in dim.columns if c != "_r"])


def atom_flags(atom: Column, residue: Column) -> dict[str, Column]:
    """Pharmacophore flags as 0 or 1. An alpha or beta carbon of a residue named CA is none."""
    a, r = F.upper(F.trim(atom)), F.upper(F.coalesce(F.trim(residue), F.lit("")))
    rule = None
    for k, (_, atoms, residues) in enumerate(FLAGS):
        match = a.isin(*atoms.split())
        if residues:
            match &= r.isin(*residues.split())
        elif atoms == "C CA CB":
            match &= (a == "C") | (r != "CA")
        rule = F.when(match, F.lit(k)) if rule is None else rule.when(match, F.lit(k))
    return {name: F.coalesce(rule.isin(*[k for k, (flags, _, _) in enumerate(FLAGS) if name in flags.split()]).cast("double"), F.lit(0.0)) for name in FLAG_NAMES}


# fixed values: side-chain atoms that give or take a hydrogen bond
DONOR_ATOMS = {"ARG": "NE NH1 NH2", "ASN": "ND2", "GLN": "NE2", "HIS": "ND1 NE2", "LYS": "NZ", "SER": "OG", "THR": "OG1", "TRP": "NE1", "TYR": "OH"}
ACCEPTOR_ATOMS = {"ASN": "OD1", "ASP": "OD1 OD2", "GLN": "OE1", "GLU": "OE1 OE2", "HIS": "ND1 NE2", "SER": "OG", "THR": "OG1", "TYR": "OH"}
# fixed values: columns of a point's feature vector that atoms add to, chemistry, flags and table
CHEM_COLUMNS = (
    "hydrophobic", "hydrophilic", "hydrophatyIndex", "aliphatic", "aromatic", "sulfur", "hydroxyl", "basic", "acidic", "amide", "posCharge", "negCharge",
    "hBondDonor", "hBondAcceptor", "hBondDonorAcceptor", "polar", "ionizable", "atoms", "atomDensity", "atomC", "atomO", "atomN", "hDonorAtoms", "hAcceptorAtoms",
)
FLAG_COLUMNS = ("vsAromatic", "vsCation", "vsAnion", "vsHydrophobic", "vsAcceptor", "vsDonor")
TABLE_COLUMNS = ("apRawValids", "apRawInvalids", "atomicHydrophobicity")
_OWN = ("hydrophobic", "hydrophilic", "hydropathy", "aliphatic", "aromatic", "sulfur", "hydroxyl", "basic", "acidic", "amide", "pos_charge", "neg_charge", "h_donor", "h_acceptor", "h_donor_acceptor", "polar", "ionizable")

# fixed values: the second set of residue properties, residues of each value; those not named have 0
GRADED = {
    "hydrophobic": {1.0: "ALA CYS ILE LEU MET PHE PRO TRP VAL", 0.5: "GLY TYR", 0.3: "HEM"},
    "hydrophilic": {1.0: "ARG ASN ASP GLN GLU HIS LYS SER THR", 0.5: "GLY TYR", 0.7: "HEM"},
    "aliphatic": {1.0: "ALA ILE LEU PRO VAL"},
    "aromatic": {1.0: "HIS PHE TRP TYR HEM"},
    "sulfur": {1.0: "CYS MET"},
    "hydroxyl": {1.0: "SER THR TYR"},
    "basic": {1.0: "ARG HIS LYS"},
    "acidic": {1.0: "ASP GLU"},
    "amide": {1.0: "ASN GLN"},
    "pos_charge": {1.0: "ARG LYS", 0.5: "HIS"},
    "neg_charge": {1.0: "ASP GLU"},
    "h_donor": {1.0: "ARG ASN CYS GLN HIS LYS SER THR TRP TYR"},
    "h_acceptor": {1.0: "ASN ASP GLN GLU SER THR TYR HEM"},
    "h_donor_acceptor": {1.0: "ASN GLN SER THR TYR"},
    "polar": {1.0: "ARG ASN ASP CYS GLN GLU HIS LYS SER THR TYR HEM", 0.5: "TRP"},
    "ionizable": {1.0: "ARG ASP GLU HIS LYS", 0.5: "CYS TYR"},
}
HEM_HYDROPATHY = -2.0


def graded_properties(spark: SparkSession) -> DataFrame:
    """The second residue dimension: the standard residues, the three mapped ones, HEM and UNK."""
    rows = []
    for name in [*HYDROPATHY, *STANDARD, "HEM", "UNK"]:
        own = STANDARD.get(name, name)
        value = lambda table: next((v for v, names in table.items() if own in names.split()), 0.0)  # noqa: B023, E731
        rows.append((name, HYDROPATHY.get(own, HEM_HYDROPATHY if own == "HEM" else 0.0), *(value(t) for t in GRADED.values())))
    return spark.createDataFrame(rows, "residue_name string, hydropathy double, " + ", ".join(f"{c} double" for c in GRADED))


def with_graded(df: DataFrame, residue: str = "residue_name") -> DataFrame:
    """Joins the second residue dimension (25 rows); residues that it doesn't name are UNK, null ones too."""
    dim = graded_properties(df.sparkSession).withColumnRenamed("residue_name", "_r")
    known = [r["_r"] for r in dim.select("_r").collect()]
    name = F.upper(F.trim(residue))
    return df.withColumn("_n", F.when(name.isin(known), name).otherwise("UNK")).join(F.broadcast(dim), F.col("_n") == F.col("_r")).drop("_r", "_n")


def _named(table: dict[str, str], residue: Column, atom: Column) -> Column:
    """Whether a table names the atom of the residue."""
    return F.coalesce(F.concat(residue, F.lit("."), atom).isin([f"{r}.{a}" for r, atoms in table.items() for a in atoms.split()]), F.lit(False))


def atom_features(atom: Column, element: Column, residue: Column) -> dict[str, Column]:
    """What an atom adds to a point beside its residue's properties: itself, its element, and whether its side chain gives or takes a hydrogen bond there.

    The element counts by its symbol or by the first letter of the atom's name;
    carbon goes before oxygen, and that before nitrogen.
    """
    a, r = F.upper(F.trim(atom)), F.upper(F.coalesce(F.trim(residue), F.lit("")))
    e = F.upper(F.coalesce(F.trim(element), F.lit("")))
    is_ = {x: (e == x) | a.startswith(x) for x in "CON"}
    kind = F.when(is_["C"], "C").when(is_["O"], "O").when(is_["N"], "N").otherwise("")
    out = {"atoms": F.lit(1.0), "atomDensity": F.lit(1.0)} | {f"atom{x}": (kind == x).cast("double") for x in "CON"}
    return out | {"hDonorAtoms": _named(DONOR_ATOMS, r, a).cast("double"), "hAcceptorAtoms": _named(ACCEPTOR_ATOMS, r, a).cast("double")}


def atom_vectors(atoms: DataFrame, table: DataFrame | None = None, flags: DataFrame | None = None, power: float = 2.0, keep_sign: bool = False) -> DataFrame:
    """``atom_name, residue_name, element`` and the 33 values of every kind of atom, for a table of the kinds.

    table: ``atomName`` (``RES.ATOM``) and the columns of ``TABLE_COLUMNS``;
    flags: ``atomName`` and those of ``FLAG_COLUMNS``, which go before the
    rules of ``atom_flags``. Kinds are few, so both are joined to them by
    broadcast.
    """
    kinds = atoms.select(*[F.upper(F.trim(c)).alias(c) for c in ("atom_name", "residue_name", "element")]).distinct()
    # mapped residues have no properties here
    rows = with_chemistry(kinds.withColumn("_p", F.when(~F.col("residue_name").isin(list(STANDARD)), F.col("residue_name"))), "_p")
    own = {c: F.col(o) for c, o in zip(CHEM_COLUMNS, _OWN)} | atom_features(F.col("atom_name"), F.col("element"), F.col("residue_name"))
    rule = atom_flags(F.col("atom_name"), F.col("residue_name"))
    key = F.concat_ws(".", "residue_name", "atom_name")
    rows = rows.select("atom_name", "residue_name", "element", key.alias("_k"), *[own[c].cast("double").alias(c) for c in CHEM_COLUMNS], *[rule[n].alias(f"_{c}") for c, n in zip(FLAG_COLUMNS, FLAG_NAMES)])
    for dim, columns in ((table, TABLE_COLUMNS), (flags, FLAG_COLUMNS)):
        if dim is not None:
            rows = rows.join(F.broadcast(dim.select(F.trim("atomName").alias("_k"), *columns)), "_k", "left")
        else:
            rows = rows.select("*", *[F.lit(None).cast("double").alias(c) for c in columns])
    raw = lambda c: F.coalesce(c, F.lit(0.0))
    powered = [power_feature(raw(F.col(c)), power, keep_sign).alias(c) for c in TABLE_COLUMNS]
    return rows.select("atom_name", "residue_name", "element", *CHEM_COLUMNS, *[F.coalesce(c, f"_{c}").alias(c) for c in FLAG_COLUMNS], *powered)


def point_features(points: DataFrame, atoms: DataFrame, group: str, item: str, vectors: DataFrame, radius: float = 6.0, wide: float = 11.3) -> DataFrame:
    """``item`` and 35 features of every point: 34 values of the atoms within ``radius`` summed by 1 - d / radius, and the number of atoms within ``wide``.

    ``atoms`` holds the plain number of atoms within the radius. Points far
    from all atoms have zeros. Atoms carry their kind only through the distance
    join; the kind's values are looked up behind it, in the same stage that
    begins the sums, so pairs are never shuffled.
    """
    from voxelmill.operators.spatial import AXES, radius_join

    upper = lambda c: F.coalesce(F.upper(F.trim(c)), F.lit(""))
    kinds = vectors.select(F.concat_ws("|", *[upper(c) for c in ("atom_name", "residue_name", "element")]).alias("_kind"), *CHEM_COLUMNS, *FLAG_COLUMNS, *TABLE_COLUMNS)
    right = atoms.select(group, F.concat_ws("|", *[upper(c) for c in ("atom_name", "residue_name", "element")]).alias("_kind"), F.col("bfactor").alias("bfactor"), *AXES)
    near = radius_join(points.select(group, item, *AXES), right, group, wide).join(F.broadcast(kinds), "_kind")
    w = F.when(F.col("d2") <= radius * radius, falloff(F.sqrt("d2"), radius)).otherwise(0.0)
    inner = F.count(F.when(F.col("d2") <= radius * radius, 1))
    names = [*CHEM_COLUMNS, *FLAG_COLUMNS, *TABLE_COLUMNS, "bfactor"]
    sums = near.groupBy(item).agg(*[(inner.cast("double") if c == "atoms" else F.sum(w * F.col(c))).alias(c) for c in names], F.count("*").cast("double").alias("protrusion"))
    return points.select(item).join(sums, item, "left").fillna(0.0, [*names, "protrusion"])
