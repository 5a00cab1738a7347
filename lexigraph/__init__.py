"""lexigraph: documentation retrieval and text processing as Spark plans.

operators   keyword, vector and hybrid retrieval, catalog, chunking, index maintenance
sources     scans of documentation trees, presets, configuration, table layouts
functions   expressions: text, vectors, labels, identifiers
plans       query-language compiler, dispatch of search modes
streaming   the ingest pipeline as a file stream
llm         corpus preparation for language models; stands alone
"""

from __future__ import annotations

import io
import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Gives the workers of a session this package, once: they needn't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_lexigraph_shipped", False):
        return
    here, packed = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("lexigraph", os.path.relpath(path, here)))
    path = os.path.join(tempfile.mkdtemp(prefix="lexigraph-ship-"), "lexigraph.zip")
    with open(path, "wb") as f:
        f.write(packed.getvalue())
    sc.addPyFile(path)
    sc._lexigraph_shipped = True
