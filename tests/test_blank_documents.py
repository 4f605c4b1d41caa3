"""Queries over texts against their SQL where documents are blank, missing or hold a lone <."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera import catalogue
from tests.compare import check

TEXTS = ["", " ", "\n", "\t \n", "|", "| |", "---", ":-:", "| --- |\n", ".", "...\n", "| a | b |", "a.", "a\n\nb \n", "a < b", "<", "<i>\n</i>", None]


@pytest.mark.parametrize("name", ["drop_markers", "normalised_text"])
def test_blank_documents(spark, tmp_path, name):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": pa.array(TEXTS, pa.string())}), tmp_path / "documents.parquet")
    check(catalogue.QUERIES[name], catalogue.ORACLES[name], spark, str(tmp_path))
