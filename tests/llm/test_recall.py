"""How many of the keys that stand in the given texts are discovered by their context."""

from __future__ import annotations

import re

import pytest

from pairloom.llm.pii import find_personal_data, instances
from pairloom.llm.tables import table

KEY = re.compile(r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{24,}(?![0-9A-Za-z])")


def test_signs_are_no_part_of_an_identifier():
    key = "24be" * 10
    for token in (key, f'"{key}"###', f"({key}),", f"__{key}__", f"### {key}"):
        text = f"token = {token} end"
        found = [text[a:b] for a, b, *_ in instances(text, [])]
        assert found == [key]
    # One sign on either side tells the pattern, however many there are.
    a, b = (instances(f'token = "{key}"{tail} end', [])[0][4] for tail in ("", "###"))
    assert a == b == ['token = "_"', '= "_" end']
    assert instances(key, [])[0][:2] == (0, 40) and instances(key, [])[0][4] == ["^ _", "^ _ "]
    assert instances("### -- ___", []) == [] and instances("12-34 (", []) == []


@pytest.mark.parametrize("scale, least", [("sf0.01", 0.9), ("sf0.1", 0.9)])
def test_recall_of_keys(spark, sf, scale, least):
    docs = table(spark, sf.replace("sf0.001", scale), "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    wanted = {(d, *m.span()) for d, t in texts.items() for m in KEY.finditer(t)}
    found = {(r.doc_id, s["start"], s["end"]) for r in find_personal_data(docs).select("row.doc_id", "found").collect() for s in r.found}
    assert len(wanted) >= 10 and len(wanted & found) >= least * len(wanted)
    print(len(wanted & found), "of", len(wanted), "and", len(found - wanted), "others")
