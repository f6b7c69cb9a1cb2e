"""Licence scan: known licence sentences in a known order.

Each text is cut into sentences, each sentence is normalised and looked up among the known ones, and the sequence of
identifiers found is matched against ordered rules: a rule's sentences must occur in its order, others may lie between.
A rule whose sentences are part of another matching rule's gives way to it.

A text is cut in two ways, as notices of one line and as wrapped pages, and a rule may match either: by lines, where a
line break ends a sentence unless the next line starts in lower case; and by paragraphs, where only a line without
letters and digits does. Comment marks, indents, stars and list numbers are punctuation and fall away as such.

Defined results: null ids and texts, and texts without a known sentence (empty ones too), give no rows; long texts are
read whole, in time in proportion to their length; a licence stated twice is one row, and of sentences at one place (a
tie can't occur within a cut) the order is the text's; repeated rows of an id count as one, different texts of one id are
one text after another; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import id_text, table
from tallyweave.llm.license_data import RULES, SENTENCES, TRIGGERS

#: Marks that end a sentence come singly before a cut, so that a run of them costs its length and not its square.
RUN, WRAP = r"([.!?;:])[.!?;:]+", r"\n([a-z])"
END = r"""[.!?;:]["')\]}]*[ \t\r\n\f]+"""
LINES, PAGE = END + r"|\n+", END + r"|\n[^A-Za-z0-9\n]*\n"


def _within(short: tuple[str, ...], long: tuple[str, ...]) -> bool:
    rest = iter(long)
    return len(short) < len(long) and all(s in rest for s in short)


def _pattern(ids: tuple[str, ...]) -> str:
    return ".*".join(f" {i} " for i in ids)


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentence_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, by_line, by_page): the identifiers of the known sentences of a text, in order, with blanks around each."""
    texts = id_text(docs, id_col, text_col)
    low = F.lower("text")
    maybe = F.lit(False)
    for t in TRIGGERS:
        # the blanks of a trigger may be a line break or several blanks in the text
        maybe |= low.contains(t) if " " not in t else low.rlike(t.replace(" ", "[^a-z0-9]+"))
    body = F.regexp_replace("text", RUN, "$1")
    cuts = F.array(F.split(F.regexp_replace(body, WRAP, " $1"), LINES), F.split(body, PAGE))
    known = docs.sparkSession.createDataFrame(list(SENTENCES.items()), "sentence string, sid string")
    rows = texts.filter(maybe).distinct().select("doc_id", F.posexplode(cuts).alias("cut", "parts")).select("doc_id", "cut", F.posexplode("parts").alias("pos", "raw"))
    found = rows.select("doc_id", "cut", "pos", _normal(F.col("raw")).alias("sentence")).join(F.broadcast(known), "sentence")

    def sequence(cut: int) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(F.col("cut") == cut, F.struct("pos", "sid"))))
        return F.concat(F.lit(" "), F.array_join(F.transform(ordered, lambda s: s["sid"]), "  "), F.lit(" "))

    return found.groupBy("doc_id").agg(sequence(0).alias("by_line"), sequence(1).alias("by_page"))


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rule, licence, sentences): a row for each rule that a text meets and no longer matching rule holds."""
    matched = {name: F.col("by_line").rlike(_pattern(ids)) | F.col("by_page").rlike(_pattern(ids)) for name, _, ids in RULES}
    met = sentence_sequences(docs, id_col, text_col).select("doc_id", *(c.alias(name) for name, c in matched.items()))
    found = []
    for name, licence, ids in RULES:
        holds = F.col(name)
        for other, _, more in RULES:
            if _within(ids, more):
                holds &= ~F.col(other)
        found.append(F.when(holds, F.struct(F.lit(name).alias("rule"), F.lit(licence).alias("licence"), F.lit(len(ids)).alias("sentences"))))
    rows = met.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("m"))
    return rows.select("doc_id", "m.rule", "m.licence", "m.sentences")


def op9_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def op9_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(s)}, {q(i)})" for s, i in SENTENCES.items())
    rules = ", ".join(f"({q(n)}, {q(c)}, {len(i)}, {q(_pattern(i))})" for n, c, i in RULES)
    longer = ", ".join(f"({q(a)}, {q(b)})" for a, _, i in RULES for b, _, j in RULES if _within(i, j))
    return f"""
WITH known(sentence, sid) AS (VALUES {known}), rules(rule, licence, sentences, pattern) AS (VALUES {rules}),
     longer(short, long) AS (VALUES {longer}),
     body AS (SELECT doc_id, regexp_replace(text, {q(RUN)}, '\1', 'g') AS t FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
     cut AS (SELECT doc_id, 0 AS way, string_split_regex(regexp_replace(t, {q(WRAP)}, ' \1', 'g'), {q(LINES)}) AS parts FROM body
             UNION ALL SELECT doc_id, 1, string_split_regex(t, {q(PAGE)}) FROM body),
     rows AS (SELECT doc_id, way, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM cut),
     found AS (SELECT doc_id, way, pos, sid FROM rows JOIN known ON trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) = sentence),
     seqs AS (SELECT doc_id, way, ' ' || string_agg(sid, '  ' ORDER BY pos, sid) || ' ' AS sequence FROM found GROUP BY doc_id, way),
     m AS (SELECT DISTINCT doc_id, rule, licence, sentences FROM seqs, rules WHERE regexp_matches(sequence, pattern))
SELECT doc_id, rule, licence, sentences::INTEGER AS sentences FROM m
WHERE NOT EXISTS (SELECT 1 FROM longer l JOIN m o ON o.rule = l.long WHERE l.short = m.rule AND o.doc_id = m.doc_id)
"""
