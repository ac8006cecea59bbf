"""Few-shot prompts (FN-3, FN-4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift import settings as S


def prompt_keys(language: Column) -> Column:
    """FN-4: label words of the prompt per language (en / NULL and zhs); others default to en."""
    en, zh = S.PROMPT_KEYS["en"], S.PROMPT_KEYS["zhs"]
    return F.struct(*[F.when(language == "zhs", F.lit(zh[k])).otherwise(F.lit(en[k])).alias(k)
                      for k in ("TEXT", "TASK", "EXAMPLES")])


def build_prompt(task: Column, fields: Column, examples: Column, text: Column, keys: Column) -> Column:
    """FN-3: task line, examples (text + one '[field]: value' line per field, or the raw values),
    then the input text. ``examples``: array<struct<TEXT, VALUES map<string,string>>>."""
    def example(e):
        per_field = F.array_join(F.transform(fields, lambda f: F.concat(
            F.lit("["), f, F.lit("]: "), F.coalesce(F.element_at(e["VALUES"], f), F.lit("")), F.lit("\n"))), "")
        raw = F.concat(F.to_json(e["VALUES"]), F.lit("\n"))
        return F.concat(keys["TEXT"], F.lit(": "), e["TEXT"], F.lit(" \n\n"),
                        F.when(F.size(fields) > 0, per_field).otherwise(raw))
    return F.concat(keys["TASK"], F.lit(": "), task, F.lit(" \n\n"), keys["EXAMPLES"], F.lit(": \n\n"),
                    F.array_join(F.transform(examples, example), ""), keys["TEXT"], F.lit(": "), text)
