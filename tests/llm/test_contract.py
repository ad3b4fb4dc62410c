"""Every query of the subpackage against its SQL where it has one; what pN_found promises where it hasn't."""

import pytest

from skein import llm

from ..conftest import tuples
from ..test_contract import oracle_rows, rows_of

PAIRS = [(name, m) for m in llm.modules() for name in m.ORACLE]


@pytest.mark.parametrize("name,module", PAIRS, ids=[n for n, _ in PAIRS])
def test_query_equals_sql(spark, sf, name, module):
    df = module.QUERIES[name](spark, sf)
    names, want = oracle_rows(sf, module.ORACLE[name])
    assert sorted(df.columns) == names
    assert rows_of(df, names) == want


COLUMNS = {"p7_found": ["field_name", "name_a", "name_b"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "subject"]}


@pytest.mark.parametrize("name", [n for m in llm.modules() for n in m.QUERIES if n not in m.ORACLE])
def test_query_runs(spark, sf, name):
    df = next(m.QUERIES[name] for m in llm.modules() if name in m.QUERIES)(spark, sf)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.count()
    assert rows > 0
    if name.endswith("_found"):
        assert len(set(tuples(df))) == rows


def test_labels_held_out(spark, sf):
    """Of the documents whose labels were kept back, most come out with the areas they are labelled with."""
    from skein.llm.subjects import subjects
    from skein.session import read

    docs, seeds = read(spark, sf.replace("sf0.001", "sf0.01"), "documents", "doc_id", "text"), read(spark, sf.replace("sf0.001", "sf0.01"), "doc_subject_labels", "doc_id", "subject").dropna()
    got, want = {}, {}
    for r in subjects(docs, seeds.where("doc_id % 4 <> 0"), "doc_id", "text", "subject").collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    for r in seeds.where("doc_id % 4 = 0").collect():
        want.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(d) == w for d, w in want.items()) >= 0.8 * len(want)
