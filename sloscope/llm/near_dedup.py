"""The pipeline's near-dedup: of documents that are near-duplicates of each other one stays.

Near means a Jaccard similarity of five-word shingles of 0.8 or more, verified on the whole
sets. Candidates come first from ``simhash``: fingerprints of three-word shingles that its
deletion-variant signatures link at three or fewer bits. Most pairs at 0.8 are further apart
than that (figures in the README), so the bands of ``minhash`` then give the links between
what is still in different components, and none is lost.

Defined cases: a null text has no words, and texts without words are equal; fewer words
than a shingle make one shingle of the whole sequence. Case and white space don't count.
Very long texts have their signatures taken in parts. Of a component one row stays, as in
``simhash.keep_heads``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloscope.llm import minhash
from sloscope.llm.common import KEY
from sloscope.llm.simhash import keep_one

#: Least similarity, in hundredths.
NEAR = 80


def keep_heads(docs: DataFrame) -> DataFrame:
    """One row of each component stays, with all its columns."""
    prints, found = minhash.components(docs, NEAR, empty_alike=True, fingerprints=True)
    stays = found.select(F.col("node").alias("_fp"), F.struct(*(f"head.{c}" for c in KEY)).alias("stays"))
    return keep_one(docs, prints.select(*KEY, F.col("node").alias("_fp")), stays)
