"""Registry of the training-data queries and of the SQL that checks them."""

from __future__ import annotations

from inkstrata.llm.bpe_codec import op5_bpe_encode
from inkstrata.llm.decontamination import op4_decontamination
from inkstrata.llm.license_scan import op9_license_scan
from inkstrata.llm.order_minhash import op3_order_minhash
from inkstrata.llm.pii import op6_pii
from inkstrata.llm.secret_scan import ORACLE as SECRETS_SQL
from inkstrata.llm.secret_scan import op1_secret_scan
from inkstrata.llm.simhash_dedup import op10_simhash_dedup
from inkstrata.llm.token_counts import op2_token_counts
from inkstrata.llm.toxicity import op7_toxicity
from inkstrata.llm.url_filter import ORACLE as URLS_SQL
from inkstrata.llm.url_filter import op8_url_filter

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_counts": op2_token_counts,
    "op3_order_minhash": op3_order_minhash,
    "op4_decontamination": op4_decontamination,
    "op5_bpe_encode": op5_bpe_encode,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_license_scan": op9_license_scan,
    "op10_simhash_dedup": op10_simhash_dedup,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": SECRETS_SQL,
    "op8_url_filter": URLS_SQL,
}
