"""Readers and writers of the engine's tables and files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as Win, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table read in fewer pieces than there are cores (one small file), dealt to all of them; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(table(spark, folder, name))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; a temporary one only where none is set and there is no cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="resonant-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: What this process has put into the shared folder.
_PLACES: list[str] = []


def new_place(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses; `clear_shared` deletes it."""
    _PLACES.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _PLACES[-1]


def clear_shared(spark: SparkSession) -> int:
    """Delete everything that this process put into the shared folder, and say how many places that were.

    Results are lazy and read these places, so this is for when all results are saved.
    """
    for place in _PLACES:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    n = len(_PLACES)
    _PLACES.clear()
    return n


def written(df: DataFrame, what: str) -> DataFrame:
    """The table written to the shared folder and read back, so that its lineage ends there."""
    spark = df.sparkSession
    path, schema = new_place(spark, what), df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def split_tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def read_tokens_csv(spark: SparkSession, path: str, *, last_wins: bool = False) -> DataFrame:
    """(song_id, tokens, token_count) from a CSV file with a header; last_wins: ids are trimmed, empty ones skipped, the last of equals kept."""
    raw = spark.read.csv(path, header=True)
    if missing := {"song_id", "tokens"} - set(raw.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    if last_wins:
        # the place of a row: files by name, then where in a file; only places are compared, so texts are neither sorted nor gathered by id
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
        raw = raw.select("*", place.alias("_at")).withColumn("song_id", F.trim("song_id")).where("song_id != ''")
        raw = raw.join(raw.groupBy("song_id").agg(F.max("_at").alias("_at")), ["song_id", "_at"], "left_semi")
    tokens = split_tokens(F.col("tokens"))
    return raw.select("song_id", tokens.alias("tokens"), F.size(tokens).alias("token_count"))


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array, or one object on each line, told apart by the first character."""
    first = spark.read.text(path, wholetext=True).select(F.left(F.trim("value"), F.lit(1))).first()
    reader = spark.read.option("multiLine", bool(first) and first[0] == "[")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_map(spark: SparkSession, path: str, value: str = "struct<artist:string,song:string,lyrics:string>") -> DataFrame:
    """(key, value.*) from a file that holds one object of objects."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "v")).select("key", "v.*")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term, cnt) from an object of numbers."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("term", "cnt"))


def in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """rows with their position (from 0) in the order in which they are read; only one number for each partition is gathered."""
    spot = F.monotonically_increasing_id()
    placed = rows.withColumn("_part", F.shiftright(spot, 33)).withColumn("_at", spot.bitwiseAND(F.lit((1 << 33) - 1)))
    size = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    start = size.select("_part", (F.sum("_n").over(Win.orderBy("_part")) - F.col("_n")).alias("_start"))
    return placed.join(F.broadcast(start), "_part").withColumn(name, F.col("_at") + F.col("_start")).drop("_part", "_at", "_start")


def read_posts(spark: SparkSession, path: str, *, prefer: str = "expanded_tokens", raw_text: bool = True, limit: int | None = None) -> DataFrame:
    """(post_idx, text) from one post on each line: the preferred tokens, else the clean ones, else the raw text unless that is switched off."""
    raw = in_file_order(spark.read.json(path), "post_idx")
    options = [F.when(F.size(c) > 0, F.array_join(c, " ")) for c in dict.fromkeys((prefer, "clean_tokens")) if c in raw.columns]
    out = raw.select("post_idx", F.coalesce(*options, *(["raw_text"] if raw_text and "raw_text" in raw.columns else []), F.lit("")).alias("text"))
    return out.orderBy("post_idx").limit(limit) if limit is not None else out


def read_json_files(spark: SparkSession, folder: str, pattern: str = "*.json", schema: str | None = None) -> DataFrame:
    """JSON arrays of all files of a folder whose names fit."""
    return read_json_array(spark, f"{folder}/{pattern}", schema)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, label) of the rows flagged 1; rows without three fields are skipped."""
    raw = spark.read.csv(path, sep="\t", schema="word string, label string, flag string", mode="DROPMALFORMED")
    return raw.where("trim(flag) = '1'").select(F.lower(F.trim("word")).alias("word"), F.lower(F.trim("label")).alias("label")).distinct()


def read_emoji(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="phrase string, emoji string").where("phrase is not null and emoji is not null").select(F.trim("emoji").alias("emoji"), F.trim("phrase").alias("phrase"))


def read_merge_map(spark: SparkSession, path: str, k: int = 29) -> DataFrame:
    """(old_id, new_id) from the groups of a merge report; the identity over k ids if there is none."""
    try:
        raw = spark.read.option("multiLine", True).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.range(k).select(F.col("id").cast("int").alias("old_id"), F.col("id").cast("int").alias("new_id"))
    return raw.select(F.posexplode("groups").alias("new_id", "g")).select(F.explode("g").alias("old_id"), "new_id").select(F.col("old_id").cast("int").alias("old_id"), "new_id")


def guessed_columns(df: DataFrame) -> tuple[str, str]:
    """Text and label column of a labelled table: the string column with the longest first value, and a column that is named like a label."""
    first = df.first()
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name.lower() not in ("label", "labels", "emotion", "class", "target")]
    if not texts or first is None:
        raise ValueError("no text column")
    label = next((c for c in df.columns if c.lower() in ("label", "labels", "emotion", "class", "target")), None)
    if label is None:
        raise ValueError("no label column")
    return max(texts, key=lambda c: len((first[c] or "").strip())), label


def read_labelled(spark: SparkSession, path: str, classes: tuple[str, ...]) -> DataFrame:
    """(text, label 0..) from .json, .jsonl or .csv of unknown columns; rows without text or known label are dropped."""
    raw = spark.read.csv(path, header=True) if path.endswith(".csv") else read_json_any(spark, path)
    text, label = guessed_columns(raw)
    names = F.array(*(F.lit(c) for c in classes))
    own = F.lower(F.trim(F.col(label).cast("string")))
    number = F.when(own.rlike(r"^\d+$"), own.cast("int")).otherwise(F.array_position(names, own).cast("int") - 1)
    return raw.select(F.trim(text).alias("text"), number.alias("label")).where((F.col("text") != "") & F.col("label").between(0, len(classes) - 1))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """One row for every text file below a folder."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True)


def tsv_safe(c: Column) -> Column:
    return F.regexp_replace(c, r"[\t\r\n]+", " ")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_tokens_csv(df: DataFrame, path: str) -> None:
    df.select("song_id", F.array_join("tokens", " ").alias("tokens")).write.mode("overwrite").csv(path, header=True)


def write_candidates(ranked: DataFrame, path: str) -> None:
    """One JSON object for each query with its ranked list."""
    nested = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("candidates"))
    nested.write.mode("overwrite").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object on each line."""
    rows.write.mode("overwrite").json(path)


def write_recommendations(ranked: DataFrame, path: str) -> None:
    """One JSON object for each query with its recommendations (rank, doc_id, score)."""
    nested = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("recommendations"))
    write_json(nested, path)


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Named tables below a folder."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def save_index(index, path: str) -> None:
    """An index of `operators.retrieval.build_index`, each file's postings in the order of terms so that a query reads only its terms' row groups.

    They stay where the join with the vocabulary by term has put them.
    """
    tables = index._asdict()
    tables["postings"] = tables["postings"].sortWithinPartitions("term", "doc_id")
    save_tables(tables, path)


def read_index(spark: SparkSession, path: str):
    from ..operators.retrieval import Index

    return Index(**read_tables(spark, path, Index._fields))


def write_idf(index, path: str) -> None:
    """(term, df, idf) as one JSON object on each line."""
    write_json(index.vocabulary.join(index.idf, "term").select("term", "df", "idf"), path)


def write_graph(edges: DataFrame, stats: DataFrame, path: str) -> None:
    """Edges (src, dst, weight) by source, and the graph's one row of statistics."""
    save_tables({"edges": edges.repartitionByRange("src").sortWithinPartitions("src"), "metadata": stats}, path)


def read_graph(spark: SparkSession, path: str, vectors: str | None = None) -> tuple[DataFrame, ...]:
    """(edges, metadata) of a graph, and the node vectors (id, emotion, topic) if their place is given."""
    out = tuple(read_tables(spark, path, ("edges", "metadata")).values())
    return (*out, spark.read.parquet(vectors)) if vectors else out


def write_clusters(path: str, *, scan: DataFrame, assigned: DataFrame, sizes: DataFrame, terms: DataFrame, merged: DataFrame) -> None:
    """The artefacts of a k-means run: scan and keywords as TSV, summary of sizes and merge map as JSON, assignments by line."""
    write_tsv(scan, f"{path}/scan")
    write_tsv(terms.withColumn("term", tsv_safe(F.col("term"))), f"{path}/keywords")
    write_json(sizes, f"{path}/sizes")
    write_json(merged, f"{path}/merged")
    write_json(assigned, f"{path}/assignments")


def write_expansion_reports(reports: dict[str, DataFrame], path: str) -> None:
    """Each report of an expansion as a TSV of its own."""
    for name, rows in reports.items():
        write_tsv(rows, f"{path}/{name}")
