"""Amounts and dates of PDF attachments, by the scanner over their text layers. Rows without a PDF pass through; only the others are joined with what was found."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scan import scan
from tallyforge.operators.extract import Extractor
from tallyforge.operators.merge import extraction, merge_rows
from tallyforge.schemas import ATTACHMENT, NOTES
from tallyforge.sources.pdf import PDF_TYPE, text_layer
from tallyforge.sources.shared import saved

NO_TEXT = "NoTextLayer"


def pdf_extractor(read: Callable[[bytes], str | None] = text_layer) -> Extractor:
    """read: the text layer of a file, None if it has none; what it raises is the row's error."""

    def layers(files: pa.Array) -> pa.Array:
        out = []
        for each in files:
            rows = []
            for f in each.as_py() or []:
                row = {"doc": f["doc"], "layer": None, "failed": None}
                try:
                    row["layer"] = read(f["bytes"] or b"")
                except Exception as e:  # any bytes may come in
                    row["failed"] = f"pdf: {e}"
                rows.append(row)
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct([("doc", pa.int32()), ("layer", pa.string()), ("failed", pa.string())])))

    def run(envelopes: DataFrame, out: str) -> DataFrame:
        df = envelopes if "error" in envelopes.columns else envelopes.withColumn("error", F.lit(None).cast("string"))
        numbered = F.transform("documents", lambda d, i: F.struct(i.cast("int").alias("doc"), d["mime"].alias("mime"), d["bytes"].alias("bytes")))
        files = F.transform(F.filter(numbered, lambda d: d["mime"] == PDF_TYPE), lambda d: F.struct(d["doc"].alias("doc"), d["bytes"].alias("bytes")))
        has = F.coalesce(F.exists("documents", lambda d: d["mime"] == PDF_TYPE), F.lit(False))
        texts = saved(df.where(has).select("id", F.arrow_udf(layers, "array<struct<doc:int,layer:string,failed:string>>")(files).alias("layers")).dropDuplicates(["id"]))
        found = scan(texts.select("id", F.inline("layers")), "layer", "found", F.lit(ATTACHMENT), F.col("doc"))
        note = F.when(F.col("layer").isNull() & F.col("failed").isNull(), F.array(F.struct(F.lit(NO_TEXT).alias("kind"), F.col("doc").alias("document")))).otherwise(F.array().cast(NOTES))
        parts = found.select("id", "doc", "failed", extraction(note, amount=F.col("found.amount"), due=F.col("found.due"), issued=F.col("found.issued")).alias("extraction"))
        merged = merge_rows(parts, ["id"]).withColumnRenamed("extraction", out)
        errors = texts.select("id", F.get(F.filter("layers", lambda x: x["failed"].isNotNull()), F.lit(0)).alias("first")).select("id", F.when(F.col("first").isNotNull(), F.format_string("attachment %d: %s", "first.doc", "first.failed")).alias("_error"))
        joined = df.where(has).join(merged.join(errors, "id"), "id").withColumn("error", F.coalesce("error", "_error")).drop("_error")
        return df.where(~has).withColumn(out, extraction()).unionByName(joined)

    return run
