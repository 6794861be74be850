"""Scans of the engine's inputs. Every reader is a distributed scan with a fixed schema."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.derive import ONE_LETTER, first_text, sequence_text
from plumbline.schemas import ATOMS, INVENTORY_CASE, SEARCH_RESPONSE, require_columns


def residue_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, *required: str) -> DataFrame:
    """A Parquet or CSV table, by its suffix, with the required columns (plddt and lddt at least)."""
    if path.rstrip("/").endswith((".parquet", ".pqt")):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return require_columns(df, *(required or ("plddt", "lddt")))


def score_tables(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """All CSV files of a folder, with the file name's stem as `candidate`; an error if there are none."""
    df = spark.read.schema(schema).option("header", True).option("pathGlobFilter", "*.csv").csv(folder)
    if not df.inputFiles():
        raise FileNotFoundError(f"no CSV files in {folder}")
    return df.withColumn("candidate", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1))


def json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A file that is one JSON array of objects, or one object."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def covariates(spark: SparkSession, path: str, keep: list[str]) -> DataFrame | None:
    """candidate and those of the columns that exist; None if there is no candidate column."""
    df = json_array(spark, path)
    return df.select("candidate", *(c for c in keep if c in df.columns)) if "candidate" in df.columns else None


def merge_covariates(tables: list[DataFrame]) -> DataFrame:
    """Full outer join on candidate; of repeated candidates in a table, the least row is kept."""
    merged = None
    for t in tables:
        rest = [c for c in t.columns if c != "candidate"]
        t = t.groupBy("candidate").agg(F.min(F.struct(*rest)).alias("x")).select("candidate", "x.*") if rest else t.distinct()
        merged = t if merged is None else merged.join(t, "candidate", "full")
    return merged


def candidate_ids(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """The strings of a JSON array, in file order, or the first of them."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("place", "candidate"))
    rows = rows.orderBy("place") if first is None else rows.orderBy("place").limit(first)
    return rows.select("candidate")


def cached_json(spark: SparkSession, folder: str, schema: T.StructType | str = SEARCH_RESPONSE) -> DataFrame:
    """Cached responses: file, response; a file that isn't JSON is a miss."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), "value")
    parsed = F.from_json("value", schema)
    return rows.where(F.try_parse_json("value").isNotNull()).select("file", parsed.alias("response"))


def cache_key(text: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def canonical_json(text: Column) -> Column:
    """JSON in one form: keys sorted, a space after commas and colons. Null stays null; no JSON is an error."""

    def canonical(values: pd.Series) -> pd.Series:
        return values.map(lambda v: json.dumps(json.loads(v), sort_keys=True), na_action="ignore")

    return F.pandas_udf(canonical, T.StringType())(text)


#: Addresses whose documents are kept by entry, or by entry and entity.
ENTRY_URL, ENTITY_URL = "https://data.rcsb.org/rest/v1/core/entry/", "https://data.rcsb.org/rest/v1/core/polymer_entity/"


def cache_path(url: Column, body: Column | None = None) -> Column:
    """Where, in the cache's folder, the response to a URL and a JSON body (null: none) is kept."""
    part = lambda k: F.element_at(F.split(url, "/"), k)
    name = F.when(url.startswith(ENTITY_URL), F.concat(F.lit("polymer_entity/"), part(-2), F.lit("_"), part(-1)))
    name = name.when(url.startswith(ENTRY_URL), F.concat(F.lit("entry/"), part(-1)))
    if body is not None:
        name = name.when(body.isNotNull(), F.concat(F.lit("search/"), cache_key(url), F.lit("_"), cache_key(canonical_json(body))))
    return F.concat(name.otherwise(F.concat(F.lit("other/"), cache_key(url))), F.lit(".json"))


def max_identity(response: Column) -> tuple[Column, Column]:
    """Largest identity of the sequence services' hits (0 if none), and the number of hits."""
    hits = F.coalesce(response["result_set"], F.array())
    services = F.flatten(F.transform(hits, lambda h: F.filter(F.coalesce(h["services"], F.array()), lambda s: s["service_type"] == "sequence")))
    nodes = F.flatten(F.transform(services, lambda s: F.coalesce(s["nodes"], F.array())))
    values = F.transform(F.flatten(F.transform(nodes, lambda n: F.coalesce(n["match_context"], F.array()))), lambda c: c["sequence_identity"])
    return F.coalesce(F.array_max(values), F.lit(0.0)), F.size(hits)


def best_hit(responses: DataFrame) -> DataFrame:
    """candidate, max_identity, best_hit, n_hits, parse_failed over all services; the first maximum.

    responses: candidate, response. Without hits the identity is null and nothing failed; hits
    without an identity count as a failure.
    """
    total = F.coalesce(F.col("response.total_count"), F.lit(0))
    hits = responses.select("candidate", total.alias("n_hits"), F.posexplode_outer("response.result_set").alias("i", "h"))
    services = hits.select("candidate", "n_hits", "i", "h.identifier", F.posexplode_outer("h.services").alias("j", "s"))
    nodes = services.select("candidate", "n_hits", "i", "identifier", "j", F.posexplode_outer("s.nodes").alias("k", "n"))
    rows = nodes.select("candidate", "n_hits", "i", "identifier", "j", "k", F.posexplode_outer("n.match_context").alias("l", "c"))
    rows = rows.withColumn("v", F.col("c.sequence_identity"))
    order = F.struct(F.col("v"), -F.col("i"), -F.col("j"), -F.col("k"), -F.col("l"))
    best = F.max_by(F.struct("v", "identifier"), F.when(F.col("v").isNotNull(), order))
    found = rows.groupBy("candidate").agg(F.max("n_hits").alias("n_hits"), best.alias("b"))
    return found.select("candidate", F.col("b.v").alias("max_identity"), F.col("b.identifier").alias("best_hit"), "n_hits", ((F.col("n_hits") > 0) & F.col("b.v").isNull()).alias("parse_failed"))


def identity_counters(found: DataFrame) -> DataFrame:
    """One row: scored, novel and broken candidates, and whether the run is sound."""
    broken, scored = F.count_if("parse_failed"), F.count("max_identity")
    return found.agg(scored.alias("scored"), F.count_if((F.col("n_hits") == 0)).alias("novel"), broken.alias("broken"), ((broken == 0) & (scored > 0)).alias("sound"))


def covariate_rows(entries: DataFrame) -> DataFrame:
    """Covariates of entry documents, with fallbacks: candidate, sequence, release_date, title."""
    date = first_text(F.col("deposit_date"), F.col("initial_release_date"), F.col("deposition_date"))
    sequence = sequence_text(F.col("sequence_canonical"), F.col("sequence"))
    return entries.select("candidate", sequence.alias("sequence"), F.length(sequence).alias("entity_length"), date.alias("release_date"), first_text(F.col("struct_title"), F.col("title")).alias("title"))


def target_sequences(df: DataFrame, first: int | None = None) -> DataFrame:
    """candidate and sequence (canonical first) of the rows that have both."""
    rows = df.select("candidate", F.trim(sequence_text(F.col("sequence_canonical"), F.col("sequence"))).alias("sequence"))
    rows = rows.where("candidate <> '' and sequence <> ''")
    return rows if first is None else rows.orderBy("candidate").limit(first)


def a3m(spark: SparkSession, path: str) -> DataFrame:
    """candidate (the file's stem), row, header, sequence: records of a3m files, without insertions."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.a3m$", 1).alias("candidate"), "value")
    return a3m_records(text)


def a3m_records(text: DataFrame) -> DataFrame:
    """Records of a3m texts (candidate, value); lower-case letters and dots are insertions."""
    parts = text.select("candidate", F.posexplode(F.filter(F.split(F.concat(F.lit("\n"), "value"), "\n>"), lambda r: r != "")).alias("row", "record"))
    lines = F.split("record", "\n", 2)
    body = F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
    return parts.select("candidate", "row", F.trim(F.get(lines, F.lit(0))).alias("header"), F.regexp_replace(F.regexp_replace(body, r"\s", ""), "[a-z.]", "").alias("sequence"))


def aligned_msa(spark: SparkSession, path: str) -> DataFrame:
    """The non-empty sequences of an aligned Parquet MSA."""
    return require_columns(spark.read.parquet(path), "sequence").select("sequence").where("sequence <> ''")


#: File name patterns of MSAs, the preferred one first.
MSA_PATTERNS = (r"\.aligned\.pqt$", r"\.pqt$", r"\.a3m$")


def pick_msa(listing: DataFrame) -> DataFrame:
    """Of a listing (candidate, path), the path of the preferred pattern; then the first by name."""
    rank = F.coalesce(*(F.when(F.col("path").rlike(p), F.lit(i)) for i, p in enumerate(MSA_PATTERNS)))
    rows = listing.withColumn("rank", rank).where("rank is not null")
    return rows.groupBy("candidate").agg(F.min(F.struct("rank", "path")).alias("m")).select("candidate", F.col("m.path").alias("path"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON list, or of the list under `cases`; model_idx is 0 by default."""
    text = spark.read.text(path, wholetext=True)
    cases = F.coalesce(F.try_variant_get(F.parse_json("value"), "$.cases", "variant").cast("string"), F.col("value"))
    rows = text.select(F.explode(F.from_json(cases, f"array<{INVENTORY_CASE}>")).alias("c")).select("c.*")
    return rows.withColumn("model_idx", F.coalesce("model_idx", F.lit(0)))


def residue_mapping(text: Column) -> Column:
    """map<int,int> of a JSON object, or of a list of {predicted, reference}."""
    pairs = F.from_json(text, "array<struct<predicted:int,reference:int>>")
    as_list = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["predicted"], p["reference"])))
    as_object = F.transform_keys(F.from_json(text, "map<string,int>"), lambda k, _: k.cast("int"))
    return F.when(F.trim(text).startswith("["), as_list).otherwise(as_object)


def confidence_values(payload: str) -> list[float]:
    """plddt of a JSON list, bare or under `plddt` or `residue_scores`."""
    data = json.loads(payload)
    if isinstance(data, dict):
        data = next((data[k] for k in ("plddt", "residue_scores") if k in data), None)
    if not isinstance(data, list):
        raise ValueError("no list of confidences")
    return [float(x) for x in data]


def confidence_csv(spark: SparkSession, path: str) -> DataFrame:
    """residue and plddt of a CSV with a column `residue` or `residue_index`."""
    df = spark.read.option("header", True).csv(path)
    name = next((c for c in ("residue", "residue_index") if c in df.columns), None)
    if name is None:
        raise KeyError("residue or residue_index")
    return require_columns(df, "plddt").select(F.col(name).cast("int").alias("residue"), F.col("plddt").cast("double").alias("plddt"))


def atoms(spark: SparkSession, path: str) -> DataFrame:
    """path and ATOMS of the text mmCIF or PDB files at `path` (PDB and gzip by suffix)."""
    schema = f"path string, {ATOMS}"
    names = [part.split()[0] for part in schema.split(", ")]
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def step(batches):
        import gzip

        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                body = gzip.decompress(content) if name.endswith(".gz") else content
                parse = pdb_atoms if name.removesuffix(".gz").endswith((".pdb", ".ent")) else cif_atoms
                yield pd.DataFrame([(name, *a) for a in parse(body.decode())], columns=names)

    return files.mapInPandas(step, schema)


_CIF_VALUE = re.compile(r"""'((?:[^']|'(?=\S))*)'(?=\s|$)|"((?:[^"]|"(?=\S))*)"(?=\s|$)|(\S+)""")


def cif_atoms(text: str) -> list[tuple]:
    """The rows of the _atom_site loop as ATOMS, by column names; values may be quoted."""
    names: list[str] = []
    found: list[tuple] = []
    inside = False
    for line in text.splitlines():
        if line.startswith("_atom_site."):
            names.append(line.split()[0][11:])
            inside = True
        elif inside and (line.startswith(("#", "loop_", "_")) or not line.strip()):
            break
        elif inside:
            row = dict(zip(names, (a or b or c for a, b, c in _CIF_VALUE.findall(line)), strict=False))
            get = lambda *keys, row=row: next((row[k] for k in keys if row.get(k, "?") not in ("?", ".")), None)
            number = get("label_seq_id", "auth_seq_id")
            coordinates = [get("Cartn_x"), get("Cartn_y"), get("Cartn_z")]
            if number is None or None in coordinates:
                continue
            b = get("B_iso_or_equiv")
            found.append((int(get("pdbx_PDB_model_num") or 1), get("auth_asym_id", "label_asym_id"), int(number), get("label_comp_id", "auth_comp_id"), get("label_atom_id", "auth_atom_id"), *map(float, coordinates), float(b) if b else None))
    return found


def ca_residues(atom_rows: DataFrame) -> DataFrame:
    """chain, res_id, res_name of the CA atoms; of a repeated number the last one counts."""
    ca = atom_rows.where("atom_name = 'CA'").withColumn("order", F.monotonically_increasing_id())
    w = Window.partitionBy("path", "chain", "res_id").orderBy(F.desc("order"))
    return ca.withColumn("k", F.row_number().over(w)).where("k = 1").select("path", "chain", "res_id", "res_name")


def search_paths(schema: dict) -> list[str]:
    """Sorted dotted paths of a JSON schema's leaves that have a search context.

    Arrays are followed into their items, objects into their properties; only properties are leaves, so
    neither the items of an array of scalars nor an object that has properties is one.
    """
    found: set[str] = set()
    open_nodes = [("", schema)]
    while open_nodes:
        prefix, node = open_nodes.pop()
        for name, child in (node.get("properties") or {}).items():
            path = f"{prefix}.{name}" if prefix else name
            if not isinstance(child, dict):
                continue
            inner = child.get("items") if child.get("type") == "array" and "items" in child else child if child.get("properties") else None
            if isinstance(inner, dict):
                open_nodes.append((path, inner))
            elif inner is None and child.get("rcsb_search_context"):
                found.add(path)
    return sorted(found)


#: The fields of an ATOM record, as columns of the line.
_PDB = {"atom_name": (12, 16), "res_name": (17, 20), "chain": (21, 22), "res_id": (22, 26), "x": (30, 38), "y": (38, 46), "z": (46, 54), "b_factor": (60, 66)}


def pdb_atoms(text: str) -> list[tuple]:
    """The ATOM records of a PDB text as ATOMS; records without a number or coordinates are left out."""
    found, model = [], 1
    for line in text.splitlines():
        if line.startswith("MODEL"):
            model = int(line[5:].strip() or 1)
        elif line.startswith("ATOM"):
            at = {k: line[a:b].strip() for k, (a, b) in _PDB.items()}
            try:
                found.append((model, at["chain"], int(at["res_id"]), at["res_name"], at["atom_name"], float(at["x"]), float(at["y"]), float(at["z"]), float(at["b_factor"]) if at["b_factor"] else None))
            except ValueError:
                continue
    return found


def protein_atoms(atom_rows: DataFrame, model: int = 1) -> DataFrame:
    """The atoms of the model's standard amino acids."""
    return atom_rows.where((F.col("model_idx") == model) & F.col("res_name").isin(*ONE_LETTER))
