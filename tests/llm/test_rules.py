"""What the sources of the operators must and must not use."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

import sloscope.llm
from sloscope.llm import queries

HOME = Path(sloscope.llm.__file__).parent
NATIVE = ("line_dedup", "url_filters", "pii", "components", "common")


@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_use_dataframe_functions_only(name):
    text = (HOME / f"{name}.py").read_text()
    assert not re.search(r"\budf\b|pandas|pyarrow|mapIn|applyIn|\.rdd\b|mapPartitions|toPandas", text)


def test_no_operator_cuts_lineage_locally_or_crosses():
    for path in HOME.glob("*.py"):
        assert not re.search(r"localCheckpoint|crossJoin|\.sample\(|tempfile\.gettempdir", path.read_text()), path


def test_each_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
