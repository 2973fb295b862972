"""Parsed documents: JSON with a Markdown rendering, entities and file-specific parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_hash
from ..functions.sql import col

ENTITY = "struct<start:int,end:int,label:string,text:string,score:double>"
CONTENT = f"struct<text:string,hash:string,entities:array<{ENTITY}>>"
ADDRESS = "struct<address:string,displayName:string,groupName:string>"
CELL = f"struct<type:string,content:{CONTENT}>"
SHEET = f"struct<tableName:string,header:array<string>,data:array<array<{CONTENT}>>>"

#: ``tables`` has one shape for sheets and another for page layouts, so it is kept as
#: text and parsed by file type.
DOCUMENT = (
    f"fileType string, content {CONTENT}, schemaVersion int, tables string, "
    f"pages array<array<{CELL}>>, kvps array<struct<key:string,value:string>>, "
    f"footNotes array<{CONTENT}>, endNotes array<{CONTENT}>, "
    f"header map<string,{CONTENT}>, footer map<string,{CONTENT}>, "
    "sentDate string, messageId string, inReplyToMessageId string, "
    "messageIdReferences array<string>, "
    f"senderAddress {ADDRESS}, toAddresses array<{ADDRESS}>, "
    f"ccAddresses array<{ADDRESS}>, bccAddresses array<{ADDRESS}>, "
    f"subject {CONTENT}, plainTextBodyContent {CONTENT}"
)

# Kinds of files by how their tables are laid out.
SHEET_TYPES = ["Csv", "Xlsx"]
PAGE_TYPES = ["Pdf", "Png", "Jpg", "Tif"]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents of any kind; the key is the file name (last part of the path)."""
    return (
        spark.read.schema(DOCUMENT)
        .option("multiLine", True)
        .json(path)
        .withColumn("doc_id", F.element_at(F.split("_metadata.file_path", "/"), -1))
    )


def markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans): rendering and all entities of every document."""
    return docs.select(
        "doc_id",
        F.col("content.text").alias("text"),
        F.coalesce(F.col("content.entities"), F.array().cast(f"array<{ENTITY}>")).alias(
            "spans"
        ),
    )


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, label, text, score) of every entity."""
    return docs.select("doc_id", F.explode("content.entities").alias("_e")).select(
        "doc_id", "_e.*"
    )


def tables(docs: DataFrame) -> DataFrame:
    """(doc_id, table_idx, table_name, header, rows): tables of sheets and pages.

    Other kinds of documents have none.
    """
    sheets = (
        docs.where(F.col("fileType").isin(SHEET_TYPES))
        .select(
            "doc_id",
            F.posexplode(F.from_json("tables", f"array<{SHEET}>")).alias("table_idx", "_t"),
        )
        .select(
            "doc_id",
            "table_idx",
            F.col("_t.tableName").alias("table_name"),
            F.col("_t.header").alias("header"),
            F.col("_t.data").alias("rows"),
        )
    )
    laid_out = docs.where(F.col("fileType").isin(PAGE_TYPES)).select(
        "doc_id",
        F.posexplode(F.from_json("tables", f"array<array<array<{CELL}>>>")).alias(
            "table_idx", "_t"
        ),
    )
    # header: texts of the column-header cells of the first row, "" for missing cells
    head = F.transform(
        F.filter(
            F.coalesce(F.get("_t", F.lit(0)), F.array().cast(f"array<{CELL}>")),
            lambda c: c.isNull() | (c["type"] == "ColumnHeader"),
        ),
        lambda c: F.coalesce(c["content"]["text"], F.lit("")),
    )
    pages = laid_out.select(
        "doc_id",
        "table_idx",
        F.concat(F.lit("table_"), F.col("table_idx").cast("string")).alias("table_name"),
        head.alias("header"),
        F.transform("_t", lambda row: F.transform(row, lambda c: c["content"])).alias("rows"),
    )
    return sheets.unionByName(pages)


def cells(docs: DataFrame) -> DataFrame:
    """(doc_id, table_idx, table_name, row, col, header, text, hash, entities).

    A missing cell has the empty text and its hash.
    """
    listed = tables(docs).select(
        "doc_id", "table_idx", "table_name", "header", F.posexplode("rows").alias("row", "_r")
    ).select(
        "doc_id",
        "table_idx",
        "table_name",
        "header",
        "row",
        F.posexplode("_r").alias("col", "_c"),
    )
    text = F.coalesce(F.col("_c.text"), F.lit(""))
    return listed.select(
        "doc_id",
        "table_idx",
        "table_name",
        "row",
        "col",
        F.get("header", F.col("col")).alias("header"),
        text.alias("text"),
        F.coalesce(F.col("_c.hash"), F.base64(F.unhex(F.md5(text)))).alias("hash"),
        F.coalesce(F.col("_c.entities"), F.array().cast(f"array<{ENTITY}>")).alias("entities"),
    )


def cell(
    docs: DataFrame, row: int, column: int, table_name: str | None = None
) -> DataFrame:
    """One cell of every document, by position (and sheet)."""
    found = cells(docs).where((F.col("row") == row) & (F.col("col") == column))
    return found if table_name is None else found.where(F.col("table_name") == table_name)


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, kind, idx, text, entities): notes, headers, pages, mail parts."""

    def entry(part: str, kind, idx, content):
        return F.struct(
            F.lit(part).alias("part"),
            kind.cast("string").alias("kind"),
            idx.cast("int").alias("idx"),
            content["text"].alias("text"),
            content["entities"].alias("entities"),
        )

    nothing = F.lit(None).cast("string")

    def listed(part: str, name: str):
        return F.transform(
            F.coalesce(F.col(name), F.array().cast(f"array<{CONTENT}>")),
            lambda c, i: entry(part, nothing, i, c),
        )

    def mapped(part: str, name: str):
        return F.transform(
            F.coalesce(
                F.map_entries(name),
                F.array().cast(f"array<struct<key:string,value:{CONTENT}>>"),
            ),
            lambda e, i: entry(part, e["key"], i, e["value"]),
        )

    def single(part: str, name: str):
        return F.when(
            F.col(name).isNotNull(),
            F.array(entry(part, nothing, F.lit(0), F.col(name))),
        ).otherwise(F.array().cast(PART))

    pages = F.flatten(
        F.transform(
            F.coalesce(F.col("pages"), F.array().cast(f"array<array<{CELL}>>")),
            lambda page, i: F.transform(
                page, lambda c: entry("page", c["type"], i, c["content"])
            ),
        )
    )
    every = F.concat(
        listed("footnote", "footNotes"),
        listed("endnote", "endNotes"),
        mapped("header", "header"),
        mapped("footer", "footer"),
        pages,
        single("subject", "subject"),
        single("body", "plainTextBodyContent"),
    )
    return docs.select("doc_id", F.explode(every).alias("_p")).select("doc_id", "_p.*")


PART = (
    f"array<struct<part:string,kind:string,idx:int,text:string,entities:array<{ENTITY}>>>"
)


def addresses(docs: DataFrame) -> DataFrame:
    """(doc_id, role, idx, address, display_name, group_name) of mail documents."""
    roles = {"to": "toAddresses", "cc": "ccAddresses", "bcc": "bccAddresses"}
    none = F.array().cast(f"array<{ADDRESS}>")
    sender = F.when(
        F.col("senderAddress").isNotNull(), F.array("senderAddress")
    ).otherwise(none)
    lists = [("sender", sender)] + [
        (role, F.coalesce(F.col(name), none)) for role, name in roles.items()
    ]

    def listed(role: str, values):
        return F.transform(
            values,
            lambda a, i: F.struct(
                F.lit(role).alias("role"),
                i.alias("idx"),
                a["address"].alias("address"),
                a["displayName"].alias("display_name"),
                a["groupName"].alias("group_name"),
            ),
        )

    every = F.concat(*[listed(role, values) for role, values in lists])
    return docs.select("doc_id", F.explode(every).alias("_a")).select("doc_id", "_a.*")


def key_values(docs: DataFrame) -> DataFrame:
    """(doc_id, key, value) pairs found on pages and images."""
    return docs.select("doc_id", F.explode("kvps").alias("_k")).select(
        "doc_id", "_k.key", "_k.value"
    )


def expected_hash(text: str):
    """Content hash a cell or document of this text must carry."""
    return content_hash(col(text)).column()
