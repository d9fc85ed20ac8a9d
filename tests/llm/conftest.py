import datetime

import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""
    texts = [
        None, "", " ", "\n\n", "one", "a b c d", "The cat. The dog, and 12.5 things!\nNew line.",
        "ab " * 3000, "ab " * 3000, "x" * 5000, "日本語 テキスト 🙂", "é ́ combining  two  spaces \t tab",
        "<|endoftext|> special. <|ENDOFTEXT|>", "▁ mark ▁▁ marks", "a\0b nul", "İstanbul ΑΣ. ΑΣ b", "same text here now ok yes",
        "same text here now ok yes", "same text here now ok yes",
    ]
    data = [(i if i != 3 else None, t, None if i == 5 else "en", f"s{i % 3}", None if t is None else len(t), i * 1.5, "x",
             datetime.date(2020, 1, 1)) for i, t in enumerate(texts)]
    data.append(data[-1])  # a wholly repeated row
    # Columns that operators use as names of their own.
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, n_words double, shard string, start date")
