"""Every query of this subpackage runs on the smallest data with the columns that are fixed."""

import pytest

import __spark_entry__ as entry
from quirewright.llm import queries

FOUND = {
    "p1_found": ["record_type string", "record_id bigint"],
    "p2_found": ["id_a bigint", "id_b bigint"],
    "p3_found": ["paper_id bigint", "section_idx int", "line_no int", "kind string"],
    "p4_found": ["item_type string", "item_id bigint", "section_idx int"],
    "p5_found": ["paper_id bigint", "section_idx int", "end_pos int"],
    "p6_found": ["record_type string", "id_a bigint", "id_b bigint"],
    "p7_found": ["doc_id bigint", "item_id bigint"],
    "p9_found": ["doc_id bigint", "kind string", "start_pos int", "end_pos int"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, folder, name):
    df = entry.queries()[name](spark, folder)
    if name in FOUND:
        assert [f"{n} {t}" for n, t in df.dtypes] == FOUND[name]
    assert df.count() == df.distinct().count() if name in FOUND else df.count() >= 0
