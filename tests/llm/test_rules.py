from llm import brute
import pytest
from llm.llm_support import ODD, SF

from arrearly.llm import licenses, quality_rules, queries


def counts(rows):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return [(r.doc_id, *(r.measures[n] for n in names)) for r in rows]


def test_counts_are_those_of_plain_loops(odd):
    found = quality_rules.quality_rules(odd)
    assert set(found.columns) == {*odd.columns, "measures", "failed_rules"}
    want = [(i, *brute.quality_counts(t)) for i, t in ODD]
    assert sorted(counts(found.collect()), key=repr) == sorted(want, key=repr)


def test_verdicts(spark):
    clean = "The house of the man is old and it was built on the hill. " * 3
    clean += " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} of" for i in range(60))
    texts = {
        "clean": clean, "short": "Too short.", "symbols": clean.replace(" ", " ### "),
        "shout": clean.upper(), "repeat": "The same of line.\n" * 60,
        "bullets": "\n".join(f"- the point of {w}" for w in clean.split()),
    }
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    found = {r.name: r for r in quality_rules.quality_rules(df).collect()}
    assert {n for n, r in found.items() if r.kept} == {"clean"}
    assert found["short"].failed_rules == ["n_words"]
    assert "symbol_ratio" in found["symbols"].failed_rules
    assert "upper_ratio" in found["shout"].failed_rules
    assert {"dup_line_ratio", "repeat_ratio"} <= set(found["repeat"].failed_rules)
    assert "bullet_line_ratio" in found["bullets"].failed_rules


def test_rules_are_a_parameter(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    rules = (quality_rules.Rule("n_words", least=1),)
    assert [r.kept for r in quality_rules.quality_rules(df, rules).collect()] == [True, False]


def test_rules_are_one_projection(odd):
    plan = quality_rules.quality_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_empty_tables(empty):
    assert quality_rules.quality_rules(empty).count() == 0
    assert licenses.scan(empty).count() == 0


# --- licenses ------------------------------------------------------------------


def labels(spark, text):
    rows = licenses.scan(spark.createDataFrame([(text,)], "text string")).collect()
    return [(d.start, d.end, d.label, d.weight) for d in rows[0].licenses]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under the Apache License, Version 2.0.", [(0, 8, "apache-2.0", 0.95)]),
        ("This is CC BY-NC-SA 4.0!", [(2, 8, "cc-by-nc-sa", 0.6)]),
        ("SPDX-License-Identifier: GPL-3.0-or-later", [(0, 8, "gpl-3.0", 1.0)]),
        ("The MIT\nlicense and the MIT (License)", [(0, 3, "mit", 0.6), (4, 7, "mit", 0.6)]),
        ("no word of it; permitted", []),
        ("submit license", []),
        ("released into the public domain", [(0, 5, "public-domain", 0.9)]),
    ],
)
def test_signatures(spark, text, want):
    assert labels(spark, text) == want


def test_partial_overlap_keeps_the_better_rule(spark):
    rules = (
        licenses.Rule("good", "license b c", "license", 1.0),
        licenses.Rule("worse", "a license b", "license", 0.5),
        licenses.Rule("inside", "b", "license", 0.9),
    )
    df = spark.createDataFrame([("a license b c",)], "text string")
    found = licenses.scan(df, found=rules).collect()[0].licenses
    assert [(d.label, d.start, d.end) for d in found] == [("good", 1, 4)]


def test_every_rule_passes_the_gate():
    """A match of any rule must hold a word of the gate, whichever way it goes."""
    import re

    def ways(pattern):
        m = re.search(r"\(\?:([^()]*)\)(\??)|\[([^\]]*)\](\{\d\})?", pattern)
        if m is None:
            yield re.sub(r"(.)\?", r"\1", pattern)
            return
        options = m[1].split("|") if m[1] is not None else [m[3][0] * (2 if m[4] else 1)]
        for option in [*options, ""] if m[2] else options:
            yield from ways(pattern[: m.start()] + option + pattern[m.end() :])

    rules = licenses.rules()
    assert len(rules) > 200
    for rule in rules:
        for text in ways(rule.pattern):
            text = re.sub(" +", " ", text)
            assert any(g in text for g in licenses.GATE), (rule, text)
            assert re.search(rule.keyword, text), (rule, text)


def test_base_phrases(odd, spark):
    more = [(9, "mit license MIT-License x cc by cc by"), (10, "gnu general public license")]
    df = odd.select("doc_id", "text", "n_words").union(
        spark.createDataFrame([(i, t, 1) for i, t in more], "doc_id long, text string, n_words long")
    )
    found = licenses.scan(df).collect()
    got = [(r.doc_id, r.n_words, sorted((d.start, d.label) for d in r.base)) for r in found]
    want = [(i, n, sorted(p)) for i, t in ODD + more for n, p in [brute.places(t, licenses.BASE)]]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_license_query(spark, texts):
    for r in queries.op6_license_scan(spark, SF).collect():
        n, found = brute.places(texts[r.doc_id], licenses.BASE)
        starts = [s for s, _ in found]
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_given_rules_need_no_word_of_the_gate(spark):
    """Rules that callers pass are gated by their own keywords."""
    rule = licenses.Rule("acme", "acme terms of use", "acme", 0.9)
    docs = spark.createDataFrame(
        [(1, "Under ACME terms of use."), (2, "nothing"), (3, None)], "doc_id long, text string"
    )
    found = {r.doc_id: r.licenses for r in licenses.scan(docs, found=(rule,)).collect()}
    assert [(d.start, d.end, d.label) for d in found[1]] == [(1, 5, "acme")]
    assert found[2] == found[3] == []
