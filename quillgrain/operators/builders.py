"""Question, instruction and mix builders; every draw is a hash pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrain.functions import picks as P
from quillgrain.functions import text as T

# The question templates.
QUESTION_TEMPLATES = (
    "According to the provided evidence, what does the specification state about: {topic}?",
    "Based on the evidence, explain the requirement described: {topic}.",
    "What is described in the evidence regarding: {topic}?",
    "Summarize what the evidence says about: {topic}.",
)
# Questions and reasons of the instruction set.
ANCHOR_QUESTION = "You MUST output a JSON object that strictly matches the required schema. Answer using ONLY the evidence. Provide exactly 1 citation and set quote as an exact substring."
ANCHOR_REFUSAL_QUESTION = "You MUST output a JSON object that strictly matches the required schema. If the provided evidence is insufficient, refuse with cannot_answer_reason and empty citations."
DEFINITION_QUESTION = "What does the evidence define or state about: {title}?"
CONDITION_QUESTION = "Under what condition does the specification require the described behavior?"
PROCEDURE_QUESTION = "Describe the steps or process mentioned in the evidence."
REFUSAL_QUESTION = "According to the evidence, what does the specification state about: {quote}...?"
REFUSAL_REASON = "The provided evidence does not contain the information needed to answer the question."
ANCHOR_REFUSAL_REASON = "The provided evidence is insufficient to answer the question."


def picked_quotes(chunks: DataFrame) -> DataFrame:
    """The chunks with one ``quote`` picked from their candidates; null where there are none."""
    return chunks.withColumn("quote", P.pick_from(T.quote_candidates(F.col("text")), P.pick_key("quote", F.col("line_no"))))


def answerable_questions(quoted: DataFrame, n: int) -> DataFrame:
    """id, type, chunk_id, quote, question for the first n quoted chunks in hash order; one in four asks about the title."""
    key = lambda scope: P.pick_key(scope, F.col("line_no"))
    rows = P.first_by_hash(quoted.where("quote is not null"), "eval", n, "line_no")
    topic = F.when((P.pick_number(key("title"), 4) == 0) & (F.coalesce("title", F.lit("")) != ""), F.col("title")).otherwise(T.shorten(F.col("quote")))  # a title stays whole
    template = P.pick_from(F.array(*map(F.lit, QUESTION_TEMPLATES)), key("template"))
    return rows.select(F.concat(F.lit("E"), F.lpad(F.col("rank").cast("string"), 4, "0")).alias("id"), F.lit("answerable").alias("type"), "chunk_id", "quote", F.replace(template, F.lit("{topic}"), topic).alias("question"))


def mismatched_questions(quoted: DataFrame, n: int) -> DataFrame:
    """A question on one chunk with the evidence of the next in hash order: a join on shifted ranks, no product."""
    rows = P.first_by_hash(quoted.where("quote is not null"), "eval", n, "line_no")
    other = rows.select(F.col("rank").alias("r2"), F.col("chunk_id").alias("evidence_chunk"))
    both = rows.join(other, F.col("r2") == F.col("rank") % n + 1).where("chunk_id <> evidence_chunk")
    return both.select(F.concat(F.lit("U"), F.lpad(F.col("rank").cast("string"), 4, "0")).alias("id"), F.lit("unanswerable").alias("type"), F.col("chunk_id").alias("question_chunk"), "evidence_chunk", "quote")


def answer_json(answer: Column, doc: Column, section: Column, chunk: Column, quote: Column, confidence: str = "high") -> Column:
    """An answer object with one citation; the null reason is kept as a key."""
    part = lambda c: F.coalesce(c, F.lit(""))
    citation = F.struct(part(doc).alias("doc_id"), part(section).alias("section"), part(chunk).alias("chunk_id"), quote.alias("quote"))
    whole = F.struct(answer.alias("answer"), F.array(citation).alias("citations"), F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("cannot_answer_reason"))
    return F.to_json(whole, {"ignoreNullFields": "false"})


def refusal_json(reason: Column, confidence: str = "low") -> Column:
    empty = F.array().cast("array<struct<doc_id:string,section:string,chunk_id:string,quote:string>>")
    return F.to_json(F.struct(F.lit("").alias("answer"), empty.alias("citations"), F.lit(confidence).alias("confidence"), reason.alias("cannot_answer_reason")), {"ignoreNullFields": "false"})


def instruction_rows(quoted: DataFrame) -> DataFrame:
    """line_no, input (question and evidence), output (answer object) for each quoted chunk."""
    c = F.col
    block = T.evidence_block(c("chunk_id"), c("doc_id"), c("section"), c("text"))
    return quoted.select("line_no", T.user_prompt(T.shorten(c("quote")), block).alias("input"), answer_json(c("quote"), c("doc_id"), c("section"), c("chunk_id"), c("quote")).alias("output"))


def wish_requests(names: DataFrame, scenes: DataFrame, loops: int) -> DataFrame:
    """Every name with every scene, ``loops`` times; catalogues of fixed size, so their product is fixed too."""
    n, s = names.columns[0], scenes.columns[0]
    each = names.crossJoin(F.broadcast(scenes)).withColumn("loop_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(loops - 1).cast("long"))))
    return each.withColumn("label", T.wish_label(F.col(n), F.col(s), F.when(F.col("loop_no") > 0, F.lit("简短"))))


def capped_mix(rows: DataFrame, tier: str, caps: dict[str, int], scope: str, key: str) -> DataFrame:
    """Union of the tiers' first rows in hash order; each cap is a bounded top-n."""
    out = None
    for name, n in caps.items():
        part = P.first_by_hash(rows.where(F.col(tier) == name), scope, n, key)
        out = part if out is None else out.unionByName(part)
    return out


def line_tier_quote(text: Column, key: Column, low: int, high: int, most_lines: int = 3) -> Column:
    """A quote of whole lines: a line in range if any, else two joined lines, then three."""

    def joined(lines: Column, k: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(lines) - (k - 1)), lambda i: F.array_join(F.slice(lines, i, k), "\n"))
        return T.within(F.when(F.size(lines) >= k, each).otherwise(F.array().cast("array<string>")), low, high)

    def tiers(lines: Column) -> Column:
        out = P.pick_from(joined(lines, most_lines), key)
        for k in range(most_lines - 1, 0, -1):
            out = F.coalesce(P.pick_from(joined(lines, k), key), out)
        return out

    return T.let(F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != ""), tiers)


def eval_targets(total: int = 240, unanswerable: float = 0.33) -> dict[str, int]:
    """How many questions of each type an evaluation set has; halves round to even."""
    no = round(total * unanswerable)
    return {"unanswerable": no, "answerable": total - no}


def instruction_targets(train: int = 6000, held_out: int = 500, refusals: float = 0.25, anchors: float = 0.35) -> dict[str, int]:
    """Sizes of the tiers of an instruction set; anchor refusals come on top of it."""
    total = train + held_out
    no = round(total * refusals)
    yes = total - no
    return {"refusals": no, "answerables": yes, "anchors": round(yes * anchors), "anchor_refusals": max(100, no // 4)}


def require_rows(df: DataFrame, least: int) -> DataFrame:
    """``df``, or a ValueError where it has fewer than ``least`` rows; no more than that are counted."""
    found = df.limit(least).count()
    if found < least:
        raise ValueError(f"corpus too small: {found} of {least} rows")
    return df


def composed_quote(text: Column, scope: str, row: Column, low: int, high: int) -> Column:
    """An exact quote of ``low`` to ``high`` characters: a line, else two lines, else three, else a window; null where none fits."""
    key = lambda part: P.pick_key(f"{scope}-{part}", row)

    def window(t: Column) -> Column:
        n = F.length(t)
        size = F.lit(low) + P.pick_number(key("size"), (F.least(F.lit(high), n) - low + 1).cast("long"))
        at = P.pick_number(key("at"), (n - size + 1).cast("long")) + 1
        cut = T.strip(F.substr(t, at.cast("int"), size.cast("int")))
        return F.when(n >= low, F.when(F.length(cut) >= low, cut))

    return T.let(T.strip(text), lambda t: F.when(F.length(t) >= low, F.coalesce(line_tier_quote(t, key("line"), low, high), window(t))))


def evaluation_set(chunks: DataFrame, total: int = 240, unanswerable: float = 0.33) -> DataFrame:
    """id, type, question_chunk, evidence_chunk, quote: the quoted chunks in hash order, the first ones
    answerable, the next with the evidence of another chunk, numbered through.
    """
    aim = eval_targets(total, unanswerable)
    rows = P.first_by_hash(picked_quotes(chunks).where("quote is not null"), "evalset", total + 1, "line_no")
    other = rows.select(F.col("rank").alias("r2"), F.col("chunk_id").alias("next_chunk"))
    both = rows.where(F.col("rank") <= total).join(other, F.col("r2") == F.col("rank") + 1, "left")
    yes = F.col("rank") <= aim["answerable"]
    made = both.select(F.concat(F.lit("E"), F.lpad(F.col("rank").cast("string"), 4, "0")).alias("id"), F.when(yes, "answerable").otherwise("unanswerable").alias("type"), F.col("chunk_id").alias("question_chunk"), F.when(yes, F.col("chunk_id")).otherwise(F.col("next_chunk")).alias("evidence_chunk"), "quote")
    return made.where("type = 'answerable' or question_chunk <> evidence_chunk")


def instruction_set(chunks: DataFrame, train: int = 6000, held_out: int = 500, refusals: float = 0.25, anchors: float = 0.35) -> DataFrame:
    """tier, kind, line_no, question, evidence_chunk, answer, reason, output and split of an assembled set.

    Four tiers: anchors, regular answerables (definition, condition, procedure), refusals with the
    evidence of another chunk, and anchor refusals; then an order by hash and a cut into train and
    eval. Every step takes the first rows of a hash order, which a bounded top-n finds.
    """
    aim = instruction_targets(train, held_out, refusals, anchors)
    c, none = F.col, F.lit(None).cast("string")
    said = lambda tier, kind, question, quote, answer, low_high: chunks.select(F.lit(tier).alias("tier"), F.lit(kind).alias("kind"), "line_no", question.alias("question"), c("chunk_id").alias("evidence_chunk"), quote.alias("quote"), answer.alias("answer"), "doc_id", "section", F.lit(low_high).alias("confidence"))
    quoted = lambda scope, low, high: composed_quote(c("text"), scope, c("line_no"), low, high)
    first = said("anchor", "anchor", F.lit(ANCHOR_QUESTION), quoted("anchor", 80, 220), quoted("anchor", 80, 220), "high").where("quote is not null")
    first = P.first_by_hash(first, "anchor", aim["anchors"], "line_no")
    title = F.when(F.coalesce("title", F.lit("")) != "", c("title")).otherwise("this concept")
    kinds = (
        said("regular", "definition", F.replace(F.lit(DEFINITION_QUESTION), F.lit("{title}"), title), F.when(c("text").rlike(T.DEFINITION), quoted("definition", 60, 240)), quoted("definition", 60, 240), "high"),
        said("regular", "condition", F.lit(CONDITION_QUESTION), F.when(c("text").rlike(T.CONDITION), quoted("condition", 60, 240)), quoted("condition", 60, 240), "mid"),
        said("regular", "procedure", F.lit(PROCEDURE_QUESTION), quoted("procedure", 180, 650), T.bullets(quoted("procedure", 180, 650)), "mid"),
    )
    regular = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).where("quote is not null")
    regular = P.first_by_hash(regular, "regular", aim["answerables"] - aim["anchors"], "line_no", "kind")
    yes = first.unionByName(regular).withColumn("reason", none).withColumn("output", answer_json(c("answer"), c("doc_id"), c("section"), c("evidence_chunk"), c("quote")))
    asked = P.first_by_hash(chunks.select("line_no", "chunk_id", quoted("refusal", 40, 180).alias("quote")).where("quote is not null"), "refusal", aim["refusals"] + 1, "line_no")
    shown = asked.select((c("rank") - 1).alias("rank"), c("chunk_id").alias("evidence_chunk"))
    no = asked.join(shown, "rank").where("chunk_id <> evidence_chunk").select(F.lit("refusal").alias("tier"), F.lit("refusal").alias("kind"), "line_no", F.replace(F.lit(REFUSAL_QUESTION), F.lit("{quote}"), F.substring("quote", 1, 120)).alias("question"), "evidence_chunk", F.lit(REFUSAL_REASON).alias("reason"))
    plain = P.first_by_hash(chunks.select("line_no", c("chunk_id").alias("evidence_chunk")), "anchor-refusal", aim["anchor_refusals"], "line_no")
    no = no.unionByName(plain.select(F.lit("anchor_refusal").alias("tier"), F.lit("anchor").alias("kind"), "line_no", F.lit(ANCHOR_REFUSAL_QUESTION).alias("question"), "evidence_chunk", F.lit(ANCHOR_REFUSAL_REASON).alias("reason")))
    names = ("tier", "kind", "line_no", "question", "evidence_chunk", "answer", "reason", "output")
    rows = yes.select(*names).unionByName(no.withColumn("answer", F.lit("")).withColumn("output", refusal_json(c("reason"))).select(*names))
    ranked = P.first_by_hash(rows, "set", train + held_out, "line_no", "tier", "kind")
    return ranked.withColumn("split", F.when(c("rank") <= train, "train").otherwise("eval")).select(*names, "split")


def draws(sample: DataFrame, n: int, scope: str = "draw") -> DataFrame:
    """``n`` draws with replacement from a ranked sample (rank from 1)."""
    spark = sample.sparkSession
    size = sample.agg(F.count("*").alias("size"))
    each = spark.range(n).select(F.col("id").alias("draw")).join(F.broadcast(size))
    numbered = each.withColumn("i", P.pick_number(P.pick_key(scope, F.col("draw")), F.col("size")) + 1)
    return numbered.join(sample, F.col("i") == F.col("rank")).select("draw", *[c for c in sample.columns if c not in ("rank", "pick_key")])
