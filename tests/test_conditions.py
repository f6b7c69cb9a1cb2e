import pytest

from tallyweave.lang.conditions import Target, condition_text, inherited, kept_clauses, structural_issues

TYPES = {"colors": "select_multiple", "name": "text", "age": "integer", "yesno": "select_one"}

CASES = [
    ("${yesno} = '1'", "yesno == 1"),
    ("${yesno} != 1", "yesno != 1"),
    ("${name} = 'Ana'", 'name == "Ana"'),
    ("${name} = '1'", 'name == "1"'),
    ("${name} != ''", "!missing(name)"),
    ("'' = ${name}", "missing(name)"),
    ("${age} > 18", "age > 18 & !missing(age)"),
    ("${age} <= 18", "age <= 18"),
    ("selected(${colors}, '-99')", "colors__99 == 1"),
    ("selected(${yesno}, '1')", "yesno == 1"),
    ("${colors} = '2'", "colors_2 == 1"),
    ("selected(${colors}, '1') and not(selected(${colors}, '2'))", "colors_1 == 1 & !(colors_2 == 1)"),
    ("${age} = 1 or ${age} = 2 and ${yesno} = 1", "age == 1 | (age == 2 & yesno == 1)"),
    ("(${age} = 1 or ${age} = 2) and ${yesno} = 1", "(age == 1 | age == 2) & yesno == 1"),
    ("string-length(${name}) = 3", "strlen(name) == 3"),
    ("if(${yesno} = 1, 2, 3) = 2", "cond(yesno == 1, 2, 3) == 2"),
    ("coalesce(${age}, ${yesno}, 0) = 2", "cond(!missing(age), age, cond(!missing(yesno), yesno, 0)) == 2"),
    ("regex(${name}, '^A')", 'regexm(name, "^A")'),
    ("substr(${name}, 0, 2) = 'An'", 'substr(name, 1, 2) == "An"'),
    ("${age} mod 2 = 0", "mod(age, 2) == 0"),
    ("(${age} + 1) div 2 = 3", "(age + 1) / 2 == 3"),
    ("count-selected(${colors}) >= 2", "rowtotal(colors_*) >= 2"),
    ("indexed-repeat(${age}, ${r}, 2) = 5", "age_2 == 5"),
    ("pulldata('t', 'a', 'b', ${name}) = 'x' and ${yesno} = 1", "yesno == 1"),
    ("pulldata('t', 'a', 'b', ${name}) = 'x' or ${yesno} = 1", "yesno == 1"),
    ("not(pulldata('t', 'a', 'b', ${name}) = 'x' and ${yesno} = 1)", None),
    ("pulldata('t', 'a', 'b', ${name}) = 'x'", None),
    ("0", None),
    ("", None),
    ("${name", None),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_conditions(source, want):
    assert condition_text(source, Target(TYPES)) == want


def test_dropped_parts_have_reasons():
    t = Target(TYPES)
    condition_text("selected(${colors}, ${age}) and once(random()) > 0.5", t)
    assert len(t.dropped) == 2


def test_constraints_iterations_and_groups():
    assert condition_text(". >= 1 and . <= 5", Target(TYPES, this="age")) == "age >= 1 & !missing(age) & age <= 5"
    inside = Target(TYPES, iteration=3, repeated=frozenset({"age", "colors"}))
    assert condition_text("${age} = 1 and ${yesno} = index() and selected(${colors}, 1)", inside) == "age_3 == 1 & yesno == 3 & colors_1 == 1"
    assert inherited(["${yesno} = 1", "", "${age} = 1 or ${age} = 2"], "${name} != ''", Target(TYPES)) == "yesno == 1 & (age == 1 | age == 2) & !missing(name)"
    assert inherited([], "", Target()) is None


def test_issues_and_clauses():
    assert structural_issues("a == 1 & (b == 2") == ["parentheses"]
    assert structural_issues("a == 'x' | ") == ["single quote", "dangling operator"]
    assert structural_issues('name == "it\'s (fine"') == []
    assert kept_clauses('a == 1 & gone == 2 & t == "x & y" & (0)', {"a", "t"}, {"t"}) == "a == 1"
    assert kept_clauses("gone == 1", {"a"}, set()) is None
