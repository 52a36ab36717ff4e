"""Result of one text file:  python -m sabaki FILE [DEFAULT_YEAR]"""

from __future__ import annotations

import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.extraction import DEFAULT_YEAR, extract


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    path = Path(args[0])
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    docs = spark.createDataFrame([(f"cli-{path.stem}", path.read_text(encoding="utf-8"))], "doc_id string, text string")
    row = extract(docs, int(args[1]) if args[1:] else DEFAULT_YEAR).select(F.to_json(F.struct("status", "records", "confidence", "errors")).alias("payload"), "confidence", "flags").first()
    print("--- EXTRACTION RESULT ---")
    print(json.dumps(json.loads(row.payload), indent=2, ensure_ascii=False))
    print("--- METADATA ---")
    print(f"Confidence: {row.confidence * 100:.2f}%")
    print(f"Flags: {', '.join(row.flags) or 'NONE'}")
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
