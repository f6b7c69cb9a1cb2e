"""Synthetic responses: a form's questions compiled to one column each, over a range of respondents.

Questions are computed in dependency levels, so a gate or calculation may refer to a later question; a circle settles
in a bounded number of rounds, from blanks, and is reported. Each repeat is a child table, exploded from the level around
it, whatever its depth; ``exported`` lays all out as one rectangular table. All draws are hashes of seed, variable and respondent: a change in one
question never shifts another's values.
"""

from __future__ import annotations

import datetime as dt
import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.library import Context
from tallyweave.lang.compiler import Scope, compiled
from tallyweave.lang.syntax import ExpressionError, references
from tallyweave.lang.values import as_num, as_text
from tallyweave.operators import gates
from tallyweave.operators.form import Form
from tallyweave.operators.materialize import written
from tallyweave.operators.sampling import Draw, numeric_bounds, sampled, text_max_length

Provider = Callable[[dict, Column], Column]
MOST_REPEATS = 5
START = dt.datetime(2026, 5, 11, 9)


@dataclass
class Plan:
    """What generation made besides the rows."""

    columns: list[str] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)
    gates: dict[str, gates.Gate] = field(default_factory=dict)


def levels(questions: list[dict]) -> tuple[list[list[dict]], list[str]]:
    """Questions by dependency level, form order inside each; and the names caught in a circle."""
    names = {q["variable_name"] for q in questions}
    needs = {q["variable_name"]: {r for r in references(q["relevance"], q["calculation"], *q["group_relevances"]) if r in names} for q in questions}
    out, done, left = [], set(), list(questions)
    while left:
        ready = [q for q in left if needs[q["variable_name"]] <= done]
        if not ready:
            return out, [q["variable_name"] for q in left]
        out.append(ready)
        done |= {q["variable_name"] for q in ready}
        left = [q for q in left if q["variable_name"] not in done]
    return out, []


class Scripted:
    """Fixed answers: of a cell (``plot_area_2_1``), else of a variable, else another provider's.

    An answer that the choices or the constraint refuse is an error if ``strict``; otherwise the other provider answers,
    and ``rejected`` says why.
    """

    def __init__(self, answers: dict[str, object], otherwise: Provider, strict: bool = False) -> None:
        self.answers, self.otherwise, self.strict = answers, otherwise, strict
        self.rejected: dict[str, str] = {}

    def _checked(self, key: str, question: dict) -> object:
        raw = self.answers[key]
        codes, kind = {v.strip() for v, _ in question.get("choices", ())} - {""}, question["type"]
        value, why = str(raw).strip(), None
        if kind in ("select_one", "select_multiple"):
            given = value.split() if kind == "select_multiple" else [value]
            why = f"{raw} is not among its choices" if codes and not set(given) <= codes else None
            value = " ".join(given)
        elif kind in ("integer", "decimal"):
            low, high = numeric_bounds(question.get("constraint", ""))
            try:
                value = int(value) if kind == "integer" else float(value)
                why = f"{raw} is out of bounds" if low is not None and value < low or high is not None and value > high else None
            except ValueError:
                why = f"{raw} is no {kind}"
        elif kind == "text" and (most := text_max_length(question.get("constraint", ""))) is not None and len(str(raw)) > most:
            why = f"{raw} is longer than {most}"
        if why and self.strict:
            raise ValueError(f"{key}: {why}")
        if why:
            self.rejected[key] = why
            return None
        return str(raw) if kind == "text" else value

    def __call__(self, question: dict, row: Column) -> Column:
        name, places = question["variable_name"], question.get("indexes", [])
        out = self.otherwise(question, row)
        if name in self.answers and (value := self._checked(name, question)) is not None:
            out = F.lit(value)
        for key in self.answers:
            m = re.fullmatch(re.escape(name) + r"((?:_\d+)+)", key)
            at = [int(x) for x in m[1].split("_")[1:]] if m else []
            if at and len(at) == len(places) and (value := self._checked(key, question)) is not None:
                here = F.lit(True)
                for place, k in zip(places, at):
                    here &= place == k
                out = F.when(here, F.lit(value)).otherwise(out)
        return out


scripted = Scripted


def stochastic(seed: int, today: str = "2026-05-11") -> Provider:
    def provide(question: dict, row: Column) -> Column:
        return sampled(Draw(seed, question["variable_name"], row), question["type"], question.get("constraint", ""), [v for v, _ in question.get("choices", ())], today)

    return provide


_KINDS = {"integer": "bigint", "decimal": "double", "date": "date", "datetime": "timestamp", "repeat_count": "bigint"}
#: Columns of the run that come before the questions, and those after them.
RUN, AFTER = ("CompletionDate", "SubmissionDate", "starttime", "endtime", "deviceid", "subscriberid", "simid", "devicephonenum", "username", "duration", "caseid"), ("KEY", "formdef_version")


@dataclass(frozen=True)
class Wishes:
    """What a run is told besides the form: pinned repeat counts (still gated) by repeat, and values by variable that open
    their own gate; the number of rounds in which a circle of questions may settle."""

    repeat_counts: dict[str, int] = field(default_factory=dict)
    force: dict[str, object] = field(default_factory=dict)
    rounds: int = 8


def _seconds(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def run_columns(row: Column, seed: int, cases: list[str] | None, settings: dict[str, str]) -> dict[str, Column]:
    """The values a device and a server add to each response, as columns of the respondent's number."""
    draw = lambda name: Draw(seed, f"meta {name}", row)
    digits = lambda name, first, n: (draw(name).integer(first * 10 ** (n - 1), (first + 1) * 10 ** (n - 1) - 1 if first < 9 else 10**n - 1)).cast("string")
    begun = F.lit(START.isoformat(sep=" ")).cast("timestamp") + _seconds(draw("start").integer(0, 30 * 86_400))
    duration = draw("duration").integer(300, 5400)
    ended = begun + _seconds(duration)
    sent = ended + _seconds(draw("sent").integer(0, 600))
    dealt = sorted(cases or [], key=lambda c: hash_order(seed, c))
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), row.cast("string")), 256)
    key = F.concat(F.lit("uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-4"), h.substr(13, 3), F.lit("-"), F.substring(F.lit("89ab"), draw("variant").integer(1, 4).cast("int"), F.lit(1)), h.substr(16, 3), F.lit("-"), h.substr(19, 12))
    version = settings.get("version", "").strip().removesuffix(".0")
    return {
        "CompletionDate": ended,
        "SubmissionDate": sent,
        "starttime": begun,
        "endtime": ended,
        "deviceid": F.concat(F.lit("collect:"), digits("device", 1, 6)),
        "subscriberid": digits("subscriber", 4, 15),
        "simid": digits("sim", 8, 15),
        "devicephonenum": F.concat(F.lit("+1555"), digits("phone", 5, 7)),
        "username": F.format_string("enum%03d", draw("user").integer(1, 50)),
        "duration": duration,
        "caseid": F.get(F.array(*map(F.lit, dealt)), (row % len(dealt)).cast("int")) if dealt else F.format_string("case-%04d", row + 1),
        "KEY": key,
        "formdef_version": F.lit(version) if version else F.date_format(F.date_sub(F.lit(START.date()), draw("version").integer(0, 1095).cast("int")), "yyyyMMdd"),
    }


def audit_url(kind: str, key: Column, seconds: Column, form_id: str = "synthetic_form", host: str = "survey.example.org") -> Column:
    """Where a server would keep a text or audio audit of a response."""
    bare = F.regexp_replace(key, "^uuid:", "")
    folder = F.concat(F.lit(f"https://{host}/api/v2/forms/{form_id}/submissions/"), key, F.lit("/attachments/"))
    return F.concat(folder, F.lit("TA_"), bare, F.lit(".csv")) if kind == "text audit" else F.concat(folder, F.lit("AA_"), bare, F.lit("_AFTER_"), seconds.cast("string"), F.lit("S.m4a"))


def _answered(df: DataFrame, questions: list[dict], choices: dict[str, list[tuple[str, str]]], provide: Provider, seed: int, row: Column, places: list[Column], plan: Plan, wishes: Wishes) -> DataFrame:
    """``df`` with a column for each question of one level of the form, by dependency; a closed gate leaves a blank."""
    questions = [q | {"choices": choices.get(q["choice_list"] or "", []), "indexes": places} for q in questions]
    total = F.col("_seconds")
    clock = elapsed([q["variable_name"] for q in questions if q["type"] == "calculate_here" and "duration()" in q["calculation"]], total, seed, row)
    context = Context(now=START, seconds=total, seed=seed, row_key=row, index=places[-1] if places else None)

    def cells(df: DataFrame, some: list[dict], note: bool) -> dict[str, Column]:
        made: dict[str, Column] = {}
        for q in some:
            name, kind = q["variable_name"], _KINDS.get(q["type"], "string")
            scope = Scope(df.schema, choices, context=replace(context, seconds=clock[name]) if name in clock else context)
            g = gates.relevance(q["group_relevances"], q["relevance"], scope)
            try:
                value, errors = _value(q, scope, provide, row, seed, wishes), []
            except ExpressionError as e:
                value, errors = F.lit(None), [str(e)]
            if note:
                plan.errors += [(name, e) for e in [*g.errors, *errors]]
            plan.gates[name] = g
            made[name] = F.lit(wishes.force[name]).cast(kind) if name in wishes.force else F.when(g.open, value.cast(kind))
        return made

    ordered, circle = levels(questions)
    for level in ordered:
        df = df.withColumns(cells(df, level, True))
    if circle:
        # all blank at first; each round computes them anew, with the same draws
        some = [q for q in questions if q["variable_name"] in circle]
        rounds = min(len(some) + 1, wishes.rounds)
        df = df.withColumns({q["variable_name"]: F.lit(None).cast(_KINDS.get(q["type"], "string")) for q in some})
        for k in range(rounds):
            for q in some:  # in form order, each from what is known by now
                ((name, c),) = cells(df, [q], k == 0).items()
                df = df.withColumn(name, F.nullif(c, F.lit("")) if q["type"].startswith("calculate") else c)
        plan.errors += [(name, f"is in a circle or after one: {rounds} rounds") for name in circle]
    return df


def _at(form: Form, path: list[str]) -> list[dict]:
    return [q for q in form.questions if q["repeat_path"] == path]


def generate(spark: SparkSession, form: Form, choices: dict[str, list[tuple[str, str]]], rows: int, seed: int, provider: Provider | None = None, cases: list[str] | None = None, settings: dict[str, str] | None = None, wishes: Wishes = Wishes()) -> tuple[DataFrame, Plan]:  # noqa: B008
    """One row a respondent, with the columns of the top level: the run's, answers, indicators, KEY, formdef_version.

    A closed gate leaves a blank. ``cases`` are dealt in an order of the seed, again and again if they are too few. A
    question of a run column's name takes its place.
    """
    plan, row = Plan(), F.col("_row")
    df = spark.range(rows).withColumnRenamed("id", "_row")
    df = df.withColumns(run_columns(row, seed, cases, settings or {})).withColumn("_seconds", F.col("duration").cast("double"))
    top = _at(form, [])
    df = _answered(df, top, choices, provider or stochastic(seed), seed, row, [], plan, wishes)
    columns, extra = list(RUN), {}
    for q in top:
        columns.append(q["variable_name"])
        if q["type"] == "select_multiple":
            made = _indicators(q["variable_name"], choices.get(q["choice_list"] or "", []))
            extra |= {f"{q['variable_name']}_{code}": c for code, c in made.items()}
            columns += [f"{q['variable_name']}_{code}" for code in made]
    plan.columns = ["_row", *dict.fromkeys([*columns, *AFTER])]
    return df.withColumns(extra).select(*plan.columns), plan


def _indicators(name: str, options: list[tuple[str, str]]) -> dict[str, Column]:
    """0/1 by the code as it stands in a column name."""
    tokens = F.split(F.col(name), " ")
    return {code.strip().replace("-", "_"): F.when(F.col(name).isNotNull(), F.array_contains(tokens, code).cast("int")) for code, _ in options if code.strip()}


def elapsed(names: list[str], total: Column, seed: int, row: Column) -> dict[str, Column]:
    """The seconds gone by at each of ``names``, in form order: each takes 5 to 20 % of what was left."""
    out, gone = {}, F.lit(0.0)
    for n in names:
        gone = gone + (total - gone) * (Draw(seed, f"clock {n}", row).uniform() * 0.15 + 0.05)
        out[n] = F.floor(gone)
    return out


def hash_order(seed: int, text: str) -> str:
    import hashlib

    return hashlib.sha256(f"{seed}|{text}".encode()).hexdigest()


def _value(q: dict, scope: Scope, provide: Provider, row: Column, seed: int, wishes: Wishes) -> Column:
    if q["type"].startswith("calculate"):
        v = compiled(q["calculation"], scope)
        return as_text(v)
    if q["type"] == "repeat_count":
        if q["repeat_group_name"] in wishes.repeat_counts:
            return F.lit(max(0, wishes.repeat_counts[q["repeat_group_name"]])).cast("bigint")
        low, high = numeric_bounds(q.get("constraint", ""))
        a, b = sorted((int(low if low is not None else 1), int(high if high is not None else MOST_REPEATS)))
        a = max(1, a)
        drawn = Draw(seed, q["variable_name"], row).integer(a, max(a, b))
        source = q["calculation"].strip()
        if not source:
            return drawn
        if re.fullmatch(r"-*\d+", source):
            return F.lit(max(0, int(source.lstrip("-")) * (-1 if source.startswith("-") else 1))).cast("bigint")
        n = as_num(compiled(source, scope))
        return F.when(n >= 0, F.floor(n)).otherwise(drawn).cast("bigint")
    return provide(q, row)


def _chain(form: Form, repeat: str) -> list[str]:
    """The names of the repeats from the outermost down to ``repeat``."""
    return next([*r["path"], r["name"]] for r in form.repeats if r["name"] == repeat)


def instances(respondents: DataFrame, form: Form, choices: dict[str, list[tuple[str, str]]], repeat: str, seed: int, provider: Provider | None = None, wishes: Wishes = Wishes(), plan: Plan | None = None) -> DataFrame:  # noqa: B008
    """The child table of a repeat, at any depth: a row for each instance, (KEY, idx, answers); a count of 0 has none.

    In a repeat within repeats idx is the innermost number and idx_1, idx_2, … are those around it. A name means the
    variable of the innermost level that has it, as the row of an instance holds those of all levels around. Of a
    multiple answer there are the indicators too. What can't be compiled is closed, and reported in ``plan``.
    """
    chain, made = _chain(form, repeat), plan if plan is not None else Plan()
    provide = provider or stochastic(seed)
    rows = respondents.withColumn("_seconds", F.col("duration").cast("double"))
    outer: list[Column] = []
    for depth in range(1, len(chain) + 1):
        n = F.coalesce(F.col(f"{chain[depth - 1]}_count"), F.lit(0)).cast("int")
        name = "idx" if depth == len(chain) else f"idx_{depth}"
        rows = rows.select("*", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))).alias(name))
        outer = [*outer, F.col(name)]
        rows = _answered(rows, _at(form, chain[:depth]), choices, provide, seed, F.xxhash64("_row", *outer), outer, made if depth == len(chain) else Plan(), wishes)
    inner = _at(form, chain)
    columns = ["KEY", *(f"idx_{k}" for k in range(1, len(chain))), "idx"]
    extra: dict[str, Column] = {}
    for q in inner:
        columns.append(q["variable_name"])
        if q["type"] == "select_multiple":
            extra |= {f"{q['variable_name']}_{code}": c for code, c in _indicators(q["variable_name"], choices.get(q["choice_list"] or "", [])).items()}
    return rows.withColumns(extra).select(*columns, *extra)


def exported(respondents: DataFrame, form: Form, choices: dict[str, list[tuple[str, str]]], seed: int, provider: Provider | None = None, wishes: Wishes = Wishes(), plan: Plan | None = None) -> DataFrame:  # noqa: B008
    """The rectangular export: run columns, questions in form order, KEY, formdef_version, one row a respondent.

    A question in repeats has a column for each cell of the grid of the largest counts, the outer number slowest; one
    with multiple answers has only its indicators there, the code before the numbers. Each repeat is one grouped pass
    over its instances and one join.
    """
    out, tables, most = respondents, {}, {}
    for r in form.repeats:
        tables[r["name"]] = written(instances(respondents, form, choices, r["name"], seed, provider, wishes, plan), "instances")
        above = tables[r["path"][-1]] if r["path"] else respondents
        most[r["name"]] = int(above.agg(F.max(f"{r['name']}_count")).first()[0] or 0)
    grids: dict[str, dict[str, Column]] = {r["name"]: {} for r in form.repeats}
    columns = list(RUN)
    for q in form.questions:
        name = q["variable_name"]
        codes = [c.strip().replace("-", "_") for c, _ in choices.get(q["choice_list"] or "", []) if c.strip()] if q["type"] == "select_multiple" else []
        if not q["repeat_path"]:
            columns += [name, *(f"{name}_{c}" for c in codes)]
            continue
        places = [f"idx_{k}" for k in range(1, len(q["repeat_path"]))] + ["idx"]
        for cell in itertools.product(*(range(1, most[r] + 1) for r in q["repeat_path"])):
            here = F.lit(True)
            for place, k in zip(places, cell):
                here &= F.col(place) == k
            suffix = "".join(f"_{k}" for k in cell)
            for column in [f"{name}_{c}" for c in codes] if q["type"] == "select_multiple" else [name]:
                grids[q["repeat_path"][-1]][column + suffix] = F.max(F.when(here, F.col(column)))
                columns.append(column + suffix)
    for name, cells in grids.items():
        if cells:
            out = out.join(tables[name].groupBy("KEY").agg(*(c.alias(n) for n, c in cells.items())), "KEY", "left")
    return out.select(*dict.fromkeys([*columns, *AFTER]))


def rendered(df: DataFrame) -> DataFrame:
    """All columns as export text: whole numbers plain, others to 10 significant digits, dates as the export writes them, blank as ''."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float"):
            digits = F.greatest(F.lit(0), 9 - F.floor(F.log10(F.abs(c))).cast("int"))
            shown = F.when(c == F.floor(c), c.cast("decimal(20,0)").cast("string")).otherwise(F.regexp_replace((F.floor(F.abs(c) * F.pow(F.lit(10.0), digits) + 0.5) / F.pow(F.lit(10.0), digits) * F.signum(c)).cast("string"), r"\.0$", ""))
        elif kind == "boolean":
            shown = c.cast("int").cast("string")
        elif kind == "date":
            shown = F.date_format(c, "MMM dd, yyyy")
        elif kind.startswith("timestamp"):
            shown = F.date_format(c, "MMM dd, yyyy hh:mm:ss a")
        else:
            shown = c.cast("string")
        out.append(F.coalesce(shown, F.lit("")).alias(f.name))
    return df.select(*out)
