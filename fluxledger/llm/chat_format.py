r"""Chat formatting by prefix-target expansion (operator 6, DataFrame functions only).

Every assistant turn becomes one example: all turns before it as context, its own reply as the
only trainable span. A conversation that does not end with an assistant turn also yields a row
without a target, so that every turn can be read back from the output.

Template: ``<|turn|>role<|text|>text<|end|>`` per turn. Inside roles and texts a backslash is
doubled and every control string gets a backslash after its first character; a parser that drops
a backslash and keeps the character after it restores the text exactly.

An example is one row that holds its whole context, so a conversation has to fit into a row; no
other group is ever gathered. Defined results: null text and null role are empty; turns sort by
(turn, role, text), null turn first, and repeated rows are repeated turns; a null conv_id is a
conversation of its own; columns other than conv_id, turn, role and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load


@dataclass(frozen=True)
class Template:
    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    #: Control strings of common chat templates, escaped wherever they stand in a text.
    controls: tuple[str, ...] = field(default=("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))

    def escape(self, c: Column) -> Column:
        c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
        return reduce(lambda x, w: F.replace(x, F.lit(w), F.lit(f"{w[0]}\\{w[1:]}")), self.controls, c)

    @staticmethod
    def unescape(c: Column) -> Column:
        return F.regexp_replace(c, r"(?s)\\(.)", "$1")

    def render(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.turn), self.escape(role), F.lit(self.text), self.escape(text), F.lit(self.end))


def expand(turns: DataFrame, template: Template = Template(), trainable_role: str = "assistant") -> DataFrame:
    """conv_id, example (index of the target turn), formatted, loss_start, loss_length, n_turns, is_last.

    `loss_start` and `loss_length` count characters of `formatted`; both are 0 where no turn is trained on.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    pieces = convs.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: template.render(t["role"], t["text"])).alias("pieces"))
    ends = pieces.select("conv_id", "roles", "pieces", F.size("pieces").alias("n"), F.explode(F.sequence(F.lit(1), F.size("pieces"))).alias("upto"))
    trained = F.get("roles", F.col("upto") - 1) == trainable_role
    kept = ends.withColumn("trained", trained).where(F.col("trained") | (F.col("upto") == F.col("n")))
    context = F.array_join(F.slice("pieces", F.lit(1), F.col("upto") - 1), "")
    target = F.get("pieces", F.col("upto") - 1)
    head = F.length(F.concat(F.lit(template.turn), template.escape(F.lit(trainable_role)), F.lit(template.text)))
    out = kept.select(
        "conv_id", (F.col("upto") - 1).alias("example"), F.concat(context, target).alias("formatted"), "trained",
        F.when(F.col("trained"), F.length(context) + head).otherwise(0).alias("loss_start"),
        F.when(F.col("trained"), F.length(target) - head - len(template.end)).otherwise(0).alias("loss_length"),
        F.col("upto").alias("n_turns"), (F.col("upto") == F.col("n")).alias("is_last"),
    )
    return out.withColumns({c: F.col(c).cast("long") for c in ("example", "loss_start", "loss_length", "n_turns")})


def parse(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text as array<struct<role, text>>, unescaped."""
    parts = F.slice(F.split(formatted, r"\Q" + template.turn + r"\E"), 2, 1 << 30)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, template.text, 1)
        body = F.substring(p, F.length(role) + len(template.text) + 1, F.length(p) - F.length(role) - len(template.text) - len(template.end))
        return F.struct(template.unescape(role).alias("role"), template.unescape(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(template: Template = Template()) -> Column:
    return template.unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))


PROBE = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    out = expand(turns.unionByName(probe))
    said = F.array_join(F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = out.select(
        "conv_id", "example", F.when(F.col("is_last"), F.col("n_turns")).alias("n_turns"), F.when(F.col("is_last"), F.sha2(said, 256)).alias("turns_sha256"),
        F.when(F.col("trained"), loss_text()).alias("loss"), F.length("formatted").cast("long").alias("chars"),
    )
    convs = back.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
    )
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return convs.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def _escaped(x: str) -> str:
    x = rf"replace({x}, '\', '\\')"
    for w in Template().controls:
        x = f"replace({x}, '{w}', '{w[0]}\\{w[1:]}')"
    return x


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), r AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total,
    sum(length('<|turn|>') + length({_escaped('role')}) + length('<|text|>') + length({_escaped('text')}) + length('<|end|>'))
      OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (WHERE role = 'assistant' OR n = total) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
