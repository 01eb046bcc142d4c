"""Models behind the operators, each a small protocol with a deterministic default that needs no download.

A port turns a text column into another column, so a model can be an expression, a pandas UDF or anything alike.
"""

from __future__ import annotations

import zlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    dim: int

    def embed(self, text: Column) -> Column: ...


class SentimentModel(Protocol):
    def classify(self, text: Column) -> Column:
        """A struct (label: positive, negative or neutral; confidence: 0 to 1)."""
        ...


class EntityTagger(Protocol):
    def tag(self, text: Column) -> Column:
        """An array of structs (word, entity_group, start, end, score)."""
        ...


class FigureTagger(Protocol):
    def tag(self, text: Column) -> Column:
        """An array of structs (word, entity_group, score, start, end), with the reporting concept as entity_group; null
        where tagging fails."""
        ...


class PdfReader(Protocol):
    def pages(self, content: bytes) -> list[str]: ...

    def tables(self, content: bytes) -> list[tuple[int, list[list[str]]]]: ...


class LanguageModel(Protocol):
    def complete(self, prompts: Column) -> Column: ...


class HashEmbedder:
    """Feature hashing of lower-cased words into ``dim`` buckets, then unit length; a text without words is all zero."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, text: Column) -> Column:
        dim = self.dim

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def hashed(texts: pd.Series) -> pd.Series:
            out = []
            for t in texts:
                places = [zlib.crc32(w.encode()) % dim for w in (t or "").lower().split()]
                x = np.bincount(places, minlength=dim).astype(np.float64) if places else np.zeros(dim)
                out.append((x / max(np.sqrt(x @ x), 1e-12)).astype(np.float32))
            return pd.Series(out)

        return hashed(text)


# Polarity words of financial prose.
POSITIVE = "advanced rose grew improved increased expanded recovered climbed gained profit growth strong stronger record higher upside success richer disciplined helped won delivered".split()
NEGATIVE = "fell declined dropped decreased slipped weakened contracted softened loss losses impairment decline weak lower risk disputes outage litigation cancel unable adverse shortages inflation counterfeit volatile default".split()


class LexiconSentiment:
    """Balance of polarity words: |p - n| / (p + n) with the sign as label; neutral with confidence 1 where it is even."""

    def classify(self, text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        p, n = (F.regexp_count(low, F.lit(rf"(?<![a-z])(?:{'|'.join(x)})(?![a-z])")) for x in (POSITIVE, NEGATIVE))
        # as the fields of a struct the counts are taken once, however often they are used
        return F.transform(F.array(F.struct(p.alias("p"), n.alias("n"))), lambda x: self._judge(x["p"], x["n"]))[0]

    @staticmethod
    def _judge(p: Column, n: Column) -> Column:
        label = F.when(p > n, "positive").when(p < n, "negative").otherwise("neutral")
        confidence = F.when(p == n, F.lit(1.0)).otherwise(F.abs(p - n) / (p + n))
        return F.struct(label.alias("label"), confidence.alias("confidence"))


# Endings of names.
ORG_SUFFIXES = "Inc|Corp|plc|Ltd|Group|Holdings|Partners|Systems|Materials|Energy|Financial|Industries|Logistics"


class RuleTagger:
    """Runs of capitalised words: companies by their suffix (ORG), others MISC."""

    pattern = rf"\b([A-Z][A-Za-z&'-]+(?:\s+[A-Z][A-Za-z&'-]+)*?\s+(?:{ORG_SUFFIXES})\b\.?)|\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"

    def tag(self, text: Column) -> Column:
        from ledgerloom.functions.text import regex_spans

        return F.transform(
            regex_spans(text, self.pattern),
            lambda m: F.struct(
                F.coalesce(m["groups"][0], m["groups"][1]).alias("word"),
                F.when(m["groups"][0].isNotNull(), "ORG").otherwise("MISC").alias("entity_group"),
                m["start"].alias("start"), m["end"].alias("end"), F.lit(1.0).alias("score"),
            ),
        )
