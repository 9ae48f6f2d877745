"""Queries of this package and the SQL that some of them have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lemmaforge.llm.decontaminate import OP6_SQL, op6_decontamination
from lemmaforge.llm.divergence import OP12_SQL, op12_divergence
from lemmaforge.llm.jaccard import OP4_SQL, op4_jaccard
from lemmaforge.llm.language import op13_language
from lemmaforge.llm.passages import op5_line_dedup
from lemmaforge.llm.pieces import op7_sentencepiece
from lemmaforge.llm.quality import op1_quality
from lemmaforge.llm.resample import OP11_SQL, op11_resampling
from lemmaforge.llm.shard import op8_sharding
from lemmaforge.llm.syncmers import op9_syncmers
from lemmaforge.llm.tokencount import op2_token_counts
from lemmaforge.llm.toxicity import op3_toxicity
from lemmaforge.llm.warc import OP10_SQL, op10_warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality": op1_quality,
        "op2_token_counts": op2_token_counts,
        "op3_toxicity": op3_toxicity,
        "op4_jaccard": op4_jaccard,
        "op5_line_dedup": op5_line_dedup,
        "op6_decontamination": op6_decontamination,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_sharding": op8_sharding,
        "op9_syncmers": op9_syncmers,
        "op10_warc": op10_warc,
        "op11_resampling": op11_resampling,
        "op12_divergence": op12_divergence,
        "op13_language": op13_language,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard": OP4_SQL, "op6_decontamination": OP6_SQL, "op10_warc": OP10_SQL, "op11_resampling": OP11_SQL, "op12_divergence": OP12_SQL}
