"""The queries of this subpackage by name, and their SQL where there is one."""

from __future__ import annotations

from .decontamination import op8_decontamination
from .hard_negatives import SQL as NEGATIVES_SQL
from .hard_negatives import op13_hard_negatives
from .html_main import op3_html_text
from .importance import SQL as RESAMPLING_SQL
from .importance import op12_resampling
from .langid import op9_langid
from .media import op5_media
from .mixing import SQL as MIXING_SQL
from .mixing import op6_mixing
from .near_dup import op7_near_dup
from .quality import op1_quality
from .token_counts import op4_token_counts
from .token_files import op10_token_files
from .toxicity import op2_toxicity
from .winnowing import op11_winnowing

QUERIES = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_token_counts": op4_token_counts,
    "op5_media": op5_media,
    "op6_mixing": op6_mixing,
    "op7_near_dup": op7_near_dup,
    "op8_decontamination": op8_decontamination,
    "op9_langid": op9_langid,
    "op10_token_files": op10_token_files,
    "op11_winnowing": op11_winnowing,
    "op12_resampling": op12_resampling,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {"op6_mixing": MIXING_SQL, "op12_resampling": RESAMPLING_SQL, "op13_hard_negatives": NEGATIVES_SQL}
