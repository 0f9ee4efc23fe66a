"""Text formats of the field as DataFrames: each function takes rows with a `line` column and adds typed columns.

Lines that don't have the format are left out; other columns stay. `read_lines` gives the lines of files, plain or
compressed, with the file they came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.operators.ordered import fill_forward, number_rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.input_file_name().alias("source"), F.col("value").alias("line"))


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of files with their `place`, which orders the lines of a file."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), place.alias("place"), F.col("value").alias("line"))


def first_files(spark: SparkSession, path: str, accession: str = r"(PF\d{5,})") -> DataFrame:
    """accession and path of files whose name holds an accession: of several the first by path. Only names are read."""
    names = spark.read.format("binaryFile").load(path).select("path")
    found = names.withColumn("accession", F.regexp_extract(F.element_at(F.split("path", "/"), -1), accession, 1))
    return found.where("accession <> ''").groupBy("accession").agg(F.min("path").alias("path"))


def read_records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Multi-line records, parted by separator, as one `line` each."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.input_file_name().alias("source"), F.col("value").alias("line")).where(F.btrim("line") != "")


def _cast(text: Column, kind: str) -> Column:
    return text if kind == "string" else text.try_cast(kind)


def by_pattern(df: DataFrame, pattern: str, fields: dict[str, str]) -> DataFrame:
    """One column for each group of pattern, in order, of the type given; lines that don't match are left out."""
    groups = {name: _cast(F.regexp_extract("line", pattern, k), kind) for k, (name, kind) in enumerate(fields.items(), 1)}
    return df.where(F.col("line").rlike(pattern)).withColumns(groups)


def by_delimiter(df: DataFrame, fields: dict[str, str], sep: str = "\t", comment: str | None = "#", least: int | None = None, needed: tuple[str, ...] = ()) -> DataFrame:
    """Columns by position; lines with fewer than `least` fields (all, if not given), comments and lines whose needed
    fields can't be cast are left out."""
    rows = df if comment is None else df.where(~F.col("line").startswith(comment))
    rows = rows.withColumn("_cells", F.split(F.btrim("line", F.lit("\r\n")) if sep == "\t" else F.btrim("line"), sep))
    rows = rows.where(F.size("_cells") >= (least or len(fields)))
    rows = rows.withColumns({name: _cast(F.get("_cells", F.lit(k)), kind) for k, (name, kind) in enumerate(fields.items())})
    for name in needed:
        rows = rows.where(F.col(name).isNotNull())
    return rows.drop("_cells")


# fixed format of a hit line: number, target, probability, E-value, P-value, score, structure score, columns, ranges, (length)
PROFILE_HIT = r"^\s*(\d+)\s+(\S+)\s+([\d.]+)\s+([\d.eE+-]+)\s+([\d.eE+-]+)\s+([\d.]+)\s+(-?[\d.]+)\s+(\d+)\s+(\d+-\d+)\s+(\d+-\d+)\s*\((\d+)\)"


def profile_hits(df: DataFrame) -> DataFrame:
    """Hit lines of a profile-profile search report. Unlike readers that insist on a non-negative secondary structure
    score, hits with a negative one are kept."""
    fields = {"rank": "int", "target": "string", "probability": "double", "evalue": "double", "pvalue": "double", "score": "double", "ss": "double", "cols": "int"}
    fields |= {"query_range": "string", "template_range": "string", "template_length": "int"}
    return by_pattern(df, PROFILE_HIT, fields)


def structure_hits(df: DataFrame) -> DataFrame:
    """Eleven tab-separated columns of a structure search; comment lines and bad rows are left out."""
    kinds = {"query": "string", "target": "string", "qlo": "bigint", "qhi": "bigint", "tlo": "bigint", "thi": "bigint", "ql": "bigint", "tl": "bigint"}
    kinds |= {"pctid": "double", "evalue": "double", "aq": "double"}
    return by_delimiter(df, kinds, needed=("qlo", "qhi", "tlo", "thi", "ql", "tl", "evalue"))


def alignment_hits(df: DataFrame) -> DataFrame:
    """Twelve columns query, target, identity, alnlen, qlen, tlen, ..., evalue, bits."""
    kinds = {"query": "string", "target": "string", "identity": "double", "alnlen": "bigint", "qlen": "bigint", "tlen": "bigint"}
    kinds |= {"qstart": "bigint", "qend": "bigint", "tstart": "bigint", "tend": "bigint", "evalue": "double", "bits": "double"}
    return by_delimiter(df, kinds, needed=("alnlen", "evalue"))


def table_hits(df: DataFrame) -> DataFrame:
    """White-space separated table of a sequence search: target, query, E-value, score."""
    return by_delimiter(df, {"target": "string", "query": "string", "evalue": "double", "score": "double"}, r"\s+", needed=("evalue",))


def by_header(df: DataFrame, source: str, fields: dict[str, str], sep: str = r"\s+", needed: tuple[str, ...] = ()) -> DataFrame:
    """Columns by the names in a header line, which may stand in any order with others between them: a line of the source that
    has all names among its cells. Sources without one have no rows; lines that are too short, or whose needed fields
    can't be cast, are left out."""
    rows = df.withColumn("_cells", F.split(F.btrim("line"), sep))
    names = F.array(*map(F.lit, fields))
    is_header = F.size(F.array_intersect("_cells", names)) == len(fields)
    headers = rows.where(is_header).groupBy(source).agg(F.min("_cells").alias("_names"))  # one row for each source
    rows = rows.where(~is_header).join(headers, source)
    at = {name: F.array_position("_names", name) for name in fields}
    rows = rows.where(F.size("_cells") >= F.greatest(*at.values(), F.lit(0)) if len(fields) > 1 else F.size("_cells") >= at[next(iter(fields))])
    rows = rows.withColumns({name: _cast(F.get("_cells", at[name].cast("int") - 1), kind) for name, kind in fields.items()})
    for name in needed:
        rows = rows.where(F.col(name).isNotNull())
    return rows.drop("_cells", "_names")


def scored_links(df: DataFrame) -> DataFrame:
    """Blank-separated protein links; the header line fails the cast of its score."""
    return by_delimiter(df, {"protein1": "string", "protein2": "string", "score": "bigint"}, " ", needed=("score",))


def aliases(df: DataFrame, source: str = "UniProt_AC") -> DataFrame:
    return by_delimiter(df, {"string_id": "string", "alias": "string", "source_name": "string"}).where(F.col("source_name") == source)


def cross_reference(df: DataFrame) -> DataFrame:
    """`DR   STRING; 9606.ENSP0001; -.` gives species and protein."""
    return by_pattern(df, r"^DR\s+STRING;\s*(\d+)\.([^;\s]+);", {"taxid": "bigint", "protein": "string"})


def truth_lines(df: DataFrame) -> DataFrame:
    """`acc s-e_s-e s-e`: acc, choppings and whether the entry is excluded ('?'); no domains make an empty array."""
    cells = F.filter(F.split(F.btrim("line"), r"\s+"), lambda x: x != "")
    rows = df.where(~F.btrim("line").startswith("#") & (F.btrim("line") != "")).withColumn("_cells", cells)
    rest = F.slice("_cells", 2, F.size("_cells"))
    return rows.select("*", F.get("_cells", F.lit(0)).alias("acc"), F.filter(rest, lambda x: x.rlike(r"^\d+-\d+(_\d+-\d+)*$")).alias("choppings"), F.array_contains(rest, "?").alias("excluded")).drop("_cells")


def tagged(df: DataFrame, key: str) -> DataFrame:
    """Lines of records joined by a pipe: key, place from 0, two-letter tag, value."""
    rows = df.select(key, F.posexplode(F.split("line", r"\|")).alias("place", "text"))
    return rows.select(key, "place", F.substring("text", 1, 2).alias("tag"), F.btrim(F.substr("text", F.lit(6))).alias("value"))


def secondary_structure(df: DataFrame) -> DataFrame:
    """Fixed-width residue lines: number, chain, amino acid, structure code, accessibility, the two acceptor bonds."""
    cut = lambda a, n: F.btrim(F.substring("line", a, n))
    bond, second = (F.split(F.btrim(F.substring("line", at, 11)), r",\s*") for at in (40, 51))
    rows = df.withColumns(
        {
            "resnum": cut(6, 5).try_cast("int"),
            "chain": cut(12, 1),
            "aa": cut(14, 1),
            "ss": F.when(cut(17, 1) == "", "-").otherwise(cut(17, 1)),
            "accessibility": cut(35, 4).try_cast("int"),
            "bond_offset": F.get(bond, F.lit(0)).try_cast("int"),
            "bond_energy": F.get(bond, F.lit(1)).try_cast("double"),
            "bond2_offset": F.get(second, F.lit(0)).try_cast("int"),
            "bond2_energy": F.get(second, F.lit(1)).try_cast("double"),
        }
    )
    return rows.where("resnum is not null")


def hydrogen_bonds(rows: DataFrame, key: str) -> DataFrame:
    """key, donor, acceptor, energy of the rows of secondary_structure: of bonds between the same two residues, in either
    direction, the first by line and field. Offsets of 0 and energies above -0.1 are none."""
    field = lambda n, name: F.struct(F.lit(n).alias("field"), F.col(f"{name}_offset").alias("offset"), F.col(f"{name}_energy").alias("energy"))
    each = rows.select(key, "resnum", F.explode(F.array(field(1, "bond"), field(2, "bond2"))).alias("b")).where("b.offset <> 0 and b.energy <= -0.1")
    each = each.select(key, F.col("resnum").alias("donor"), (F.col("resnum") + F.col("b.offset")).alias("acceptor"), F.col("b.field").alias("field"), F.col("b.energy").alias("energy"))
    first = each.groupBy(key, F.least("donor", "acceptor").alias("lo"), F.greatest("donor", "acceptor").alias("hi")).agg(F.min(F.struct("donor", "field", "acceptor", "energy")).alias("x"))
    return first.select(key, "x.donor", "x.acceptor", "x.energy")


def fasta(df: DataFrame) -> DataFrame:
    """Records parted by '>': id (first word of the header) and sequence."""
    head = F.split_part("line", F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.substr("line", F.length(head) + 1), r"\s", "")
    return df.select("*", F.split_part(head, F.lit(" "), F.lit(1)).alias("id"), body.alias("sequence"))


def atoms(df: DataFrame) -> DataFrame:
    """CA atoms of fixed-width coordinate lines: chain, residue number and name, x, y, z, confidence (the B-factor);
    the first of alternative positions."""
    cut = lambda a, n: F.btrim(F.substring("line", a, n))
    rows = df.where(F.col("line").startswith("ATOM") & (cut(13, 4) == "CA") & cut(17, 1).isin("", "A"))
    kinds = {"x": (31, 8), "y": (39, 8), "z": (47, 8), "plddt": (61, 6)}
    columns = {k: cut(*at).try_cast("double") for k, at in kinds.items()}
    return rows.withColumns({"resname": cut(18, 3), "chain": cut(22, 1), "resnum": cut(23, 4).try_cast("int"), **columns}).where("resnum is not null")


def table_atoms(df: DataFrame, source: str, place: str) -> DataFrame:
    """CA atoms of coordinate tables in the form of mmCIF, as atoms gives them: the `_atom_site` lines of a source name its
    columns in order. First model, and the first of alternative positions; heteroatoms are left out."""
    name = F.regexp_extract("line", r"^_atom_site\.(\S+)", 1)
    head = df.where(name != "").groupBy(source).agg(F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), name.alias("n")))).alias("_h"))
    head = head.select(source, F.transform("_h", lambda x: x["n"]).alias("_names"))  # one row for each source
    rows = df.where(F.col("line").startswith("ATOM ")).withColumn("_cells", F.split(F.btrim("line"), r"\s+")).join(head, source)
    cell = lambda n: F.get("_cells", F.array_position("_names", n).cast("int") - 1)
    rows = rows.where((cell("label_atom_id") == "CA") & cell("label_alt_id").isin(".", "?", "A") & (F.coalesce(cell("pdbx_PDB_model_num"), F.lit("1")) == "1"))
    kinds = {"x": "Cartn_x", "y": "Cartn_y", "z": "Cartn_z", "plddt": "B_iso_or_equiv"}
    columns = {k: cell(n).try_cast("double") for k, n in kinds.items()}
    number = F.coalesce(cell("auth_seq_id").try_cast("int"), cell("label_seq_id").try_cast("int"))
    rows = rows.withColumns({"resname": cell("label_comp_id"), "chain": F.coalesce(cell("auth_asym_id"), cell("label_asym_id")), "resnum": number, **columns})
    return rows.where("resnum is not null").drop("_cells", "_names")


def alignment_blocks(df: DataFrame, source: str, place: str) -> DataFrame:
    """source, full_id, acc, first, last, aln of alignment files whose rows may go on over lines: those that name the sequence
    again, and those that hold residues only and belong to the sequence named last. Blank lines, comments and `//` are
    left out. The lines of all files are numbered once, so a file of any size is no task of its own.
    """
    rows = df.select(F.col(source).alias("_source"), F.col(place).alias("_place"), "line").where(~F.btrim("line").rlike("^(#.*|//.*|)$"))
    named, bare = r"^(\S+)/(\d+)-(\d+)\s+(\S+)", r"^\s*([A-Za-z.\-]+)\s*$"
    part = lambda k: F.regexp_extract("line", named, k)
    is_named = F.col("line").rlike(named)
    name = F.struct(F.col("_source").alias("of"), part(1).alias("acc"), part(2).cast("bigint").alias("first"), part(3).cast("bigint").alias("last"))
    rows = rows.select("_source", "_place", F.when(is_named, name).alias("name"), F.when(is_named, part(4)).otherwise(F.regexp_extract("line", bare, 1)).alias("part")).where("part <> ''")
    rows = fill_forward(number_rows(rows, ["_source", "_place"], "_n"), "_n", "name").where("name.of <=> _source")
    found = rows.groupBy("_source", "name").agg(F.sort_array(F.collect_list(F.struct("_n", "part"))).alias("parts"))
    aln = F.array_join(F.transform("parts", lambda x: x["part"]), "")
    full = F.concat("name.acc", F.lit("/"), "name.first", F.lit("-"), "name.last")
    return found.select(F.col("_source").alias(source), full.alias("full_id"), "name.acc", "name.first", "name.last", aln.alias("aln"))


def aligned_errors(df: DataFrame) -> DataFrame:
    """Predicted aligned errors in JSON, as one row for each pair of residues i, j from 1."""
    matrix = F.from_json("line", "predicted_aligned_error array<array<double>>")["predicted_aligned_error"]
    rows = df.select("*", F.posexplode(matrix).alias("_i", "_row")).select("*", F.posexplode("_row").alias("_j", "pae"))
    return rows.withColumns({"i": F.col("_i") + 1, "j": F.col("_j") + 1}).drop("_i", "_j", "_row")
