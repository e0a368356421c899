"""Token counts of texts by a compiled finite-state tokenizer (see ``transducer``)."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import transducer
from tallywright.llm.common import only


def token_counts(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``tokenizer`` is the path of a ``tokenizers`` JSON file with a byte-level BPE, the same on every machine. No begin, end or
    padding tokens; strings of special tokens inside a text count as one token, the library's default. A null text is empty
    (0, 0); an empty table gives an empty result; repeated rows and null ids are counted row by row; other columns are ignored.
    """
    def count(parts):
        for part in parts:
            texts = part.column("text").to_pylist()
            n_tokens = []
            for a, b in transducer.batches(texts):
                n_tokens.extend(transducer.count_tokens(transducer.machine(tokenizer), texts[a:b]).tolist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = only(df, doc_id=doc_id, text=text).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
