"""Nested conversation records: reshaping, rewriting, rendering and token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrain.functions import text as T

# Kin names that the output rewriter looks for, and its replacements in order.
KIN = ("姐姐", "妹妹", "哥哥", "弟弟", "堂兄", "堂妹", "表哥", "表妹", "同学", "同事", "邻居")
REWRITES = (("您", "你"), ("姐姐", "姐"), ("哥哥", "哥"), ("表哥", "哥"), ("表妹", "妹妹"), ("表弟", "弟弟"), ("邻居", ""), ("尊敬的", ""), ("赵大妈", "阿姨"), ("同事", ""))
# Occasions that the input rewriter looks for, and its templates.
OCCASIONS = ("生日", "春节", "元宵节", "端午节", "七夕节", "中秋节", "重阳节", "除夕", "腊八节", "周年纪念")
WISHES = ("我想祝{r}{s}快乐", "我想给{r}{s}祝福", "我想送{r}{s}祝福", "送祝福给{r} {s}", "我想祝福{r}{s}快乐", "祝{r}{s}快乐", "送祝福给{r}{s}", "祝福{r}{s}快乐")


def turns(samples: DataFrame, key: str = "sample_id", conversation: str = "conversation") -> DataFrame:
    """key, turn_no (from 1), system, input, output; a null conversation has no turns."""
    return samples.select(key, F.posexplode(conversation).alias("pos", "t")).select(key, (F.col("pos") + 1).cast("long").alias("turn_no"), "t.system", "t.input", "t.output")


def messages(samples: DataFrame, key: str = "sample_id", conversation: str = "conversation") -> DataFrame:
    """key, place (from 0), role, text: two chat messages for each turn."""
    both = F.transform(conversation, lambda t: F.array(F.struct(F.lit("user").alias("role"), t["input"].alias("text")), F.struct(F.lit("assistant").alias("role"), t["output"].alias("text"))))
    return samples.select(key, F.posexplode(F.flatten(both)).alias("place", "m")).select(key, F.col("place").cast("long").alias("place"), "m.role", "m.text")


def instruct_rows(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """instruction, input (empty), output for each turn that has both sides."""
    return turns(samples, key).where("input is not null and output is not null").select(key, "turn_no", F.col("input").alias("instruction"), F.lit("").alias("input"), "output")


def single_turns(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """One record for each turn: key, turn_no, a conversation of that turn alone."""
    return turns(samples, key).select(key, "turn_no", F.array(F.struct("system", "input", "output")).alias("conversation"))


def drop_short(samples: DataFrame, least: int = 10, conversation: str = "conversation") -> DataFrame:
    """Records without an output under ``least`` characters; a null output counts as short."""
    return samples.where(~F.exists(conversation, lambda t: F.coalesce(F.length(t["output"]), F.lit(0)) < least))


def with_system(conversation: Column, system: Column) -> Column:
    """Every turn under another system text."""
    return F.transform(conversation, lambda t: t.withField("system", system))


def first_turn(conversation: Column, default_system: str) -> Column:
    """system (default for null or blank), input and output of the first turn, stripped; null for none."""
    t = F.get(conversation, F.lit(0))
    system = F.coalesce(F.nullif(T.strip(t["system"]), F.lit("")), F.lit(default_system))
    return F.when(t.isNotNull(), F.struct(system.alias("system"), T.strip(F.coalesce(t["input"], F.lit(""))).alias("input"), T.strip(F.coalesce(t["output"], F.lit(""))).alias("output")))


def plain_kin_output(question: Column, output: Column) -> Column:
    """For each kin name in the question the replacements are applied to the output once, in order."""
    # a fold, since nested expressions would double with every name
    def once(acc: Column, name: Column) -> Column:
        changed = acc
        for old, new in REWRITES:
            changed = F.replace(changed, F.lit(old), F.lit(new))
        return F.when(F.contains(question, name), changed).otherwise(acc)

    return F.aggregate(F.array(*map(F.lit, KIN)), output, once)


def occasion_input(question: Column, pick: Column) -> Column:
    """A question naming an occasion and no comma becomes one of the wish templates, picked by ``pick`` (0..7).

    Later occasions see the result of earlier ones.
    """
    template = F.element_at(F.array(*map(F.lit, WISHES)), (pick + 1).cast("int"))

    def once(acc: Column, name: Column) -> Column:
        role = F.substring(F.split_part(acc, name, F.lit(1)), 2, 1_000_000)
        made = F.replace(F.replace(template, F.lit("{r}"), role), F.lit("{s}"), name)
        return F.when(F.contains(acc, name) & ~F.contains(acc, F.lit(",")), made).otherwise(acc)

    return F.aggregate(F.array(*map(F.lit, OCCASIONS)), question, once)


def render_history(rows: DataFrame, key: str, place: str, role: Column, text: Column, line: str = "{role}: {text}") -> DataFrame:
    """key, history: the messages in order, a line each."""
    head, tail = line.split("{role}")[0], line.split("{role}")[1].split("{text}")
    one = F.concat(F.lit(head), role, F.lit(tail[0]), F.coalesce(text, F.lit("")), F.lit(tail[1]))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), one.alias("s")))), lambda x: x["s"]), "\n").alias("history"))


def chat_template(rows: DataFrame, key: str, place: str, role: Column, text: Column) -> DataFrame:
    """key, history in im_start/im_end form; an unknown role is an error."""
    known = F.when(role.isin("user", "assistant", "system"), role).otherwise(F.raise_error(F.concat(F.lit("unknown role "), role)))
    return render_history(rows, key, place, known, text, "<|im_start|>{role}\n{text}<|im_end|>")


def keep_recent(rows: DataFrame, key: str, place: str, most: int = 11) -> DataFrame:
    """No rows for a key with more than ``most`` messages: the chat starts anew."""
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("n", n).where(F.col("n") <= most).drop("n")


def drop_last(rows: DataFrame, key: str, place: str, n: int = 2) -> DataFrame:
    """Without the last ``n`` messages of each key."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(place)))
    return rows.withColumn("back", back).where(F.col("back") > n).drop("back")


def word_ids(text: Column, size: int = 50_000) -> Column:
    """Ids of a text's words and marks: the tokenizer's offline stand-in."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"), F.lit(0))
    return F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int"))


def tokenize_masked(prompt: Column, output: Column, most: int = 2048, most_output: int = 512, ignore: int = -100) -> Column:
    """input_ids, attention_mask, labels: output cut at ``most_output``, the prompt cut from the left to fit."""
    out = F.slice(output, 1, most_output)
    room = F.greatest(F.lit(0), F.lit(most) - F.size(out))
    kept = F.when(F.size(prompt) > room, F.when(room > 0, F.slice(prompt, F.greatest(F.lit(1), F.size(prompt) - room + 1), F.greatest(F.lit(1), room))).otherwise(F.array().cast("array<int>"))).otherwise(prompt)
    return F.struct(F.concat(kept, out).alias("input_ids"), F.array_repeat(F.lit(1), F.size(kept) + F.size(out)).alias("attention_mask"), F.concat(F.array_repeat(F.lit(ignore), F.size(kept)), out).alias("labels"))


def tokenize_right(prompt: Column, output: Column, end_id: int, most: int = 1024, ignore: int = -100) -> Column:
    """Prompt, output and the end id, all cut from the right at ``most``."""
    ids = F.concat(prompt, output, F.array(F.lit(end_id)))
    labels = F.concat(F.array_repeat(F.lit(ignore), F.size(prompt)), output, F.array(F.lit(end_id)))
    return F.struct(F.slice(ids, 1, most).alias("input_ids"), F.slice(F.array_repeat(F.lit(1), F.size(ids)), 1, most).alias("attention_mask"), F.slice(labels, 1, most).alias("labels"))


def pad_batches(rows: DataFrame, batch: str, tokens: str, pad_id: int = 0, ignore: int = -100) -> DataFrame:
    """Token structs padded to the longest of their batch."""
    longest = F.max(F.size(F.col(f"{tokens}.input_ids"))).over(Window.partitionBy(batch))

    def pad(name: str, value: int) -> Column:
        own = F.col(f"{tokens}.{name}")
        return F.concat(own, F.array_repeat(F.lit(value), (F.col("longest") - F.size(own)).cast("int"))).alias(name)

    return rows.withColumn("longest", longest).withColumn(tokens, F.struct(pad("input_ids", pad_id), pad("attention_mask", 0), pad("labels", ignore))).drop("longest")
