"""Readers.  Schemas are explicit: inference would turn maps into structs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import label_line

TRUTH = "puzzleId string, sourceImage string, type string, dimensions struct<rows:int,cols:int>, valueRange struct<min:int,max:int>, grid array<array<int>>, frequency map<string,int>, metadata struct<validatedBy:string,validatedAt:string,notes:string,filledCells:int,totalCells:int,completionPct:int,ocrCoverage:string,manualOverrides:int>"
RECOGNISED = "cells array<struct<row:int,col:int,number:int,confidence:double,rawText:string,rawOcr:string>>, bySymbol map<string,array<struct<row:int,col:int>>>, recognized int, total int, aborted boolean, abortReason string"
RUN = "puzzleId string, timestamp string, cells array<struct<row:int,col:int,expected:int,actual:int,confidence:double,match:string>>, metrics struct<accuracy:double,precision:double,recall:double,f1Score:double,coverage:double,editDistance:int,normalizedEditDistance:double,perDigit:map<string,struct<digit:int,truePositives:int,falsePositives:int,falseNegatives:int,precision:double,recall:double,f1Score:double>>>, aborted boolean, abortReason string"
DIAGNOSTIC = "meta struct<recognized:int,total:int,coverage:string,uniqueSymbols:int,gridSize:struct<rows:int,cols:int>>, grid array<array<int>>, unrecognized array<struct<r:int,c:int,rawOcr:string,rawText:string>>, lowConf array<struct<r:int,c:int,n:int,conf:double,rawOcr:string,rawText:string>>, bySymbol map<string,array<array<int>>>"
PSEUDO_LABELS = "cell string, status string, error string, number int, confidence double, rawText string, rawDigits string, strategy string, tier string, augmentations int"
PHOTOS = "photo string, status string, error string, rows int, cols int, cells_total int, cells_valid int, cells_rejected int, rejection_reasons map<string,int>, perspective_corrected boolean, processing_time_s double"


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON files of one object or one list each (or of an object a line), with the file's name."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path).withColumn("file", F.col("_metadata.file_name"))


def read_truth(spark: SparkSession, path: str, puzzle_id: str | None = None, lines: bool = False) -> DataFrame:
    df = read_json(spark, path, TRUTH, lines)
    return df if puzzle_id is None else df.where(F.col("puzzleId") == puzzle_id)


def puzzle_ids(spark: SparkSession, path: str) -> DataFrame:
    """Names of the JSON files, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "").alias("puzzle_id"))


def truth_cells(truth: DataFrame) -> DataFrame:
    """puzzle_id, row, col, expected: a row per cell of the grids."""
    rows = truth.select(F.col("puzzleId").alias("puzzle_id"), F.posexplode("grid").alias("row", "r"))
    return rows.select("puzzle_id", "row", F.posexplode("r").alias("col", "expected"))


def recognised_cells(maps: DataFrame, puzzle_id) -> DataFrame:
    return maps.select(puzzle_id.alias("puzzle_id"), F.posexplode("cells").alias("ord", "c")).select("puzzle_id", "ord", "c.row", "c.col", F.col("c.number").alias("actual"), "c.confidence")


def read_history(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Stored runs in order of time.  Files that do not parse are left out, on purpose: one bad file does not hide a puzzle's other runs."""
    return spark.read.schema(RUN).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path).orderBy("timestamp")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """file, label of ``name,label`` lines with exactly two fields and a number."""
    return spark.read.text(path).select(label_line(F.col("value")).alias("x")).where("x is not null").select("x.*")


def read_dataset(spark: SparkSession, path: str, alphabet: str = "0123456789", most: int = 2) -> DataFrame:
    """file, label of ``name,label`` lines cut at the first comma only; labels of letters outside the alphabet, or too long, are left out."""
    cut = F.split("value", ",", 2)
    rows = spark.read.text(path).where(F.size(cut) == 2).select(F.trim(cut[0]).alias("file"), F.trim(cut[1]).alias("label"))
    return rows.where((F.length("label") > 0) & (F.length("label") <= most) & (F.translate("label", alphabet, "") == ""))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths below a folder; the content column is not read unless asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", F.element_at(F.split("path", "/"), -1).alias("name"))


def existing_labels(labels: DataFrame, listing: DataFrame, alphabet: str = "^[0-9]{1,2}$") -> DataFrame:
    """Labels of files that are there and whose label fits the alphabet."""
    return labels.join(listing, labels["file"] == listing["name"], "left_semi").where(F.col("label").cast("string").rlike(alphabet))


def tiered_cells(listing: DataFrame) -> DataFrame:
    """path, digit, tier of ``tier/digit/*.png`` trees."""
    part = lambda i: F.regexp_extract("path", r"/(high|med)/(\d+)/[^/]+\.png$", i)
    return listing.where(F.col("path").rlike(r"/(high|med)/\d+/[^/]+\.png$")).select("path", part(2).cast("int").alias("digit"), part(1).alias("tier"))


def cell_images(listing: DataFrame) -> DataFrame:
    """path, row, col of ``cell_r*_c*.png`` files."""
    part = lambda i: F.regexp_extract("path", r"cell_r(\d+)_c(\d+)", i).cast("int")
    return listing.where(F.col("path").rlike(r"cell_r\d+_c\d+.*\.png$")).select("path", part(1).alias("row"), part(2).alias("col"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; files that are none are left out."""
    return spark.read.format("image").option("dropInvalid", True).load(path)
