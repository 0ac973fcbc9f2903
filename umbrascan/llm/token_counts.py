"""Token counts with a whole-token shortcut.

Before the first text is read, every vocabulary string that could be a whole pre-token is merged alone; those that come
out as one token are proven to count as one wherever they stand as a pre-token, as merges never cross pre-tokens.
Texts are then cut into pre-tokens, proven ones count one each, and only the others are merged.
"""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbrascan.llm.pretokens import Cache, is_latin, latin_pattern, once, spelled
from umbrascan.llm.shared import by_rows, strings


class WordCounter:
    """Counts tokens as the ``tokenizers`` file does for texts without special tokens added.

    The file's pattern cuts a lower-cased, composed text.  Characters below U+0300 compose to themselves and are
    lowered one by one, so such texts need no normalizer; the others go through the file's own normalizer and splitter.
    Texts that hold a special string are counted by the library as a whole.
    """

    def __init__(self, path: str, room: int = 64 << 20):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._split = latin_pattern(pattern).findall
        proven, model = self.prove(spec), self.tok.model
        self.counts = Cache(lambda p: proven.get(p) or len(model.tokenize(spelled(p))), room)
        self.counts.update(proven)

    def prove(self, spec: dict) -> dict[str, int]:
        """Pre-tokens that the model turns into one token, by their plain text."""
        end, model = spec["model"].get("end_of_word_suffix") or "", self.tok.model
        letter = {ord(spelled(chr(b))): b for b in range(128)}
        proven = {}
        for token in spec["model"]["vocab"]:
            if not token.endswith(end):
                continue
            word = token.removesuffix(end)
            plain = word.translate(letter)
            if word and plain.isascii() and spelled(plain) == word and len(model.tokenize(word)) == 1:
                proven[plain] = 1
        return proven

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        if is_latin(text):
            return sum(map(self.counts.__getitem__, self._split(text.lower())))
        calm = self.tok.normalizer.normalize_str(text)
        return sum(self.counts[calm[a:b]] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(calm))


def count(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit of every whole text; a null text counts as empty.

    Repeated rows and null keys stay; other columns are not carried.
    """
    kind = df.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch):
        counter = once(("count", path), lambda: WordCounter(path))
        n = [counter.count(t) for t in strings(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], [key, "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    counted = df.select(F.col(key), F.col(text), size).mapInArrow(by_rows(work), f"`{key}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
