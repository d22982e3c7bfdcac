"""Query of the token files."""

from __future__ import annotations

import public_tokenizers

from plumbline.llm.registry import query, table
from plumbline.llm.token_files import token_index

TOKENIZER, END_ID = public_tokenizers.path("byte_bpe_50k.json"), 2


@query("op4_token_files")
def op4_token_files(spark, folder):
    return token_index(table(spark, folder, "documents"), TOKENIZER, END_ID)
