"""Fine-tuning dataset and ticket evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.json import strict_json
from quarrylens.functions.text import digest_number
from quarrylens.operators.percentiles import RankTarget, values_at_ranks

# Fixed values -------------------------------------------------------------
TRAIN_SHARE = 0.9
SEED = 42
AMOUNT_TOLERANCE = 0.01
REQUIRED_FIELDS = ("supplier_id", "issue_type", "order_id", "amount_disputed", "priority", "resolution_requested")
TICKET_DDL = (
    "ticket_id string, supplier_id string, issue_type string, order_id string, amount_disputed double, "
    "currency string, priority string, assigned_agent string, resolution_requested string, item_returned boolean"
)
PRIORITIES = ("URGENT", "HIGH", "MEDIUM", "LOW")
# Issue type, requested resolution, item returned, fixed priority, and whether
# the log names an order and an agent.
ISSUES = (
    ("RTO_DEDUCTION_DISPUTE", "reversal", False, None, True, False),
    ("RTO_DEDUCTION_DISPUTE", "reversal", False, "URGENT", True, True),
    ("PAYMENT_DELAY", "payment_release", None, None, False, True),
    ("PAYMENT_DELAY", "payment_release", None, "HIGH", False, False),
    ("CATALOG_REJECTION", "manual_review", None, None, True, True),
    ("PENALTY_DISPUTE", "penalty_waiver", None, None, True, True),
    ("RETURN_DISPUTE", "compensation", True, None, True, True),
)
# --------------------------------------------------------------------------

# Wording of our own.
SYSTEM_PROMPT = (
    "Turn the support log into one JSON ticket with the keys ticket_id, supplier_id, issue_type, order_id, "
    "amount_disputed, currency, priority, assigned_agent, resolution_requested and item_returned. Reply with JSON only."
)
AGENTS = ("Asha", "Bruno", "Chen", "Dana", "Emre")
# A log is put together from a phrase for each field its ticket holds.
TOPICS = tuple(issue[0].replace("_", " ").lower() for issue in ISSUES)
PHRASES = {"topic": "Case of {}.", "sid": "Raised by seller {}.", "amt": "Amount at stake: {}.", "oid": "It concerns {}.", "agent": "With {} now.", "hint": "Urgency {}."}


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chatml(log: Column, ticket_json: Column, system_prompt: str = SYSTEM_PROMPT) -> Column:
    """System, user and assistant message of one training pair."""
    return F.array(message("system", F.lit(system_prompt)), message("user", log), message("assistant", ticket_json))


def ticket_to_json(ticket: Column) -> Column:
    """JSON text of a ticket, null fields written out, non-ASCII kept."""
    return F.to_json(ticket, {"ignoreNullFields": "false"})


def chat_template(messages: Column) -> Column:
    """Messages as one string with role markers."""
    return F.array_join(
        F.transform(
            messages,
            lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")),
        ),
        "",
    )


def first_with_role(messages: Column, role: str) -> Column:
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]


def without_role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] != role)


def turn_pairs(turns: DataFrame, conv: str, turn: str, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """Training messages of each user turn and the assistant turn after it.

    A user turn without reply has no assistant message, an assistant turn that
    follows no user turn no user message.  The system message is the first
    system turn of the conversation, or ``system_prompt`` without one; a
    conversation of system turns alone has a row with that message.

    The join key is (conversation, turn), so one long conversation is spread
    over all tasks.
    """
    asked = turns.filter(F.col("role") == "user").select(conv, turn, F.col("text").alias("asked"), F.lit(True).alias("asks"))
    reply = turns.filter(F.col("role") == "assistant").select(
        conv, (F.col(turn) - 1).alias(turn), F.col("text").alias("reply"), F.lit(True).alias("replies")
    )
    pairs = asked.join(reply, [conv, turn], "full")
    first = turns.groupBy(conv).agg(
        F.min_by(F.when(F.col("role") == "system", F.col("text")), F.when(F.col("role") == "system", F.col(turn))).alias("system"),
        F.max(F.col("role").isin("user", "assistant")).alias("talks"),
    )
    rows = pairs.join(first.filter("talks").select(conv, "system"), conv).unionByName(
        first.filter("not talks and system is not null").select(conv, "system"), allowMissingColumns=True
    )
    messages = F.array_compact(
        F.array(
            message("system", F.coalesce("system", F.lit(system_prompt))),
            F.when(F.col("asks"), message("user", F.col("asked"))),
            F.when(F.col("replies"), message("assistant", F.col("reply"))),
        )
    )
    return rows.select(conv, turn, messages.alias("messages"))


def order_key(ident: Column, seed: int = SEED) -> Column:
    """Shuffling key: leading bits of a digest of seed and id."""
    return digest_number(F.concat(F.lit(f"{seed}:"), ident.cast("string")))


def exact_split(df: DataFrame, ident: str, train_share: float = TRAIN_SHARE, seed: int = SEED) -> DataFrame:
    """Adds ``split``: exactly floor(n * share) rows of ``train``, the rest ``eval``.

    Rows are in the order of a seeded digest, but nothing is sorted globally:
    the digest at the cut is found as an exact rank, and only rows that share
    that digest are ordered, by id.  Ids must be unique.
    """
    keyed = df.withColumn("__key", order_key(F.col(ident), seed))
    cut = RankTarget(train_share, lambda n: F.greatest(F.floor(n * train_share), F.lit(1)))
    found = values_at_ranks(keyed, [], "__key", {"cut": cut}).first()
    if found is None:
        return df.withColumn("split", F.lit("train"))
    at = int(found["cut"])
    wanted = int(found["n"] * train_share)
    below = keyed.filter(F.col("__key") < at).count()
    last = None
    if wanted > below:
        tied = keyed.filter(F.col("__key") == at).select(ident)
        last = tied.orderBy(ident).limit(wanted - below).agg(F.max(ident)).first()[0]
    in_tie = F.lit(False) if last is None else (F.col("__key") == at) & (F.col(ident) <= F.lit(last))
    train = (F.col("__key") < at) | in_tie
    return keyed.withColumn("split", F.when(train, "train").otherwise("eval")).drop("__key")


def synthetic_pairs(ids: DataFrame, ident: str, seed: int = SEED) -> DataFrame:
    """A support log and its ticket for every id, drawn by digest.

    Fields are drawn evenly from their lists and ranges; the highest amount is
    as likely as any other.
    """

    def below(salt: str, n: int) -> Column:
        drawn = digest_number(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string"), F.lit(f":{salt}")))
        return F.pmod(drawn, F.lit(n)).cast("int")

    def at(values: tuple, index: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), index)

    drawn = ids.select(
        F.col(ident),
        below("issue", len(ISSUES)).alias("issue"),
        at(PRIORITIES, below("priority", len(PRIORITIES))).alias("drawn_priority"),
        (below("supplier", 90_000) + 10_000).cast("string").alias("sid"),
        F.concat(F.lit("ORD-"), (below("order", 9_000_000) + 1_000_000).cast("string")).alias("oid"),
        (below("amount", 4_951) + 50).alias("amt"),
        at(AGENTS, below("agent", len(AGENTS))).alias("agent"),
    )
    column = lambda i: F.get(F.array(*[F.lit(row[i]) for row in ISSUES]), F.col("issue"))
    slots = {
        "topic": at(TOPICS, F.col("issue")),
        "sid": F.col("sid"),
        "amt": F.col("amt").cast("string"),
        "oid": F.when(column(4), F.col("oid")),
        "agent": F.when(column(5), F.col("agent")),
        "hint": F.lower(F.coalesce(column(3), F.col("drawn_priority"))),
    }
    # Fields that the ticket lacks are null here, and their phrases drop out.
    log = F.concat_ws(" ", *[F.replace(F.lit(PHRASES[name]), F.lit("{}"), value) for name, value in slots.items()])
    ticket = F.struct(
        F.concat(F.lit("TKT-"), (F.col(ident) + 1000).cast("string")).alias("ticket_id"),
        F.col("sid").alias("supplier_id"),
        column(0).alias("issue_type"),
        F.when(column(4), F.col("oid")).alias("order_id"),
        F.col("amt").cast("double").alias("amount_disputed"),
        F.lit("INR").alias("currency"),
        F.coalesce(column(3), F.col("drawn_priority")).alias("priority"),
        F.when(column(5), F.col("agent")).alias("assigned_agent"),
        column(1).alias("resolution_requested"),
        column(2).alias("item_returned"),
    )
    return drawn.select(F.col(ident), log.alias("log"), ticket.alias("ticket"))


def amount_close(predicted: Column, truth: Column) -> Column:
    """Both present and within one percent of the larger of truth and 1."""
    off = F.abs(predicted - truth) / F.greatest(truth, F.lit(1.0))
    return F.coalesce(off <= AMOUNT_TOLERANCE, F.lit(False))


def amount_match(predicted: Column, truth: Column) -> Column:
    """As :func:`amount_close`, but two missing amounts agree."""
    return (predicted.isNull() & truth.isNull()) | amount_close(predicted, truth)


def ticket_scores(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Field accuracy of predicted ticket texts against true tickets.

    Adds json_valid, n_correct, field_accuracy, issue_type_correct and
    amount_correct.  Text that is not a JSON object scores zero.
    """
    variant = strict_json(F.col(predicted))
    parsed = rows.withColumn("__v", variant)
    is_object = F.coalesce(F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT")), F.lit(False))

    def same(name: str) -> Column:
        """Equal as JSON values: null or absent equals null, a number no text."""
        kind = F.schema_of_variant(F.try_variant_get("__v", f"$.{name}", "variant"))
        value = F.try_variant_get("__v", f"$.{name}", "string")
        return (
            F.when(kind.isNull() | (kind == "VOID"), true(name).isNull())
            .when(kind == "STRING", F.coalesce(value == true(name), F.lit(False)))
            .otherwise(False)
        )

    # A number given as text still counts as a number; other text does not.
    amount = F.expr("try_cast(try_variant_get(__v, '$.amount_disputed', 'string') AS double)")
    true = lambda name: F.col(f"{truth}.{name}")
    correct = [
        (amount_close(amount, true(name)) if name == "amount_disputed" else same(name)).cast("int")
        for name in REQUIRED_FIELDS
    ]
    total = correct[0]
    for flag in correct[1:]:
        total = total + flag
    checked = parsed.withColumn("json_valid", is_object)
    ok = F.col("json_valid")
    scored = checked.select(
        *rows.columns,
        "json_valid",
        F.when(ok, total).otherwise(0).alias("n_correct"),
        F.when(ok, same("issue_type")).otherwise(False).alias("issue_type_correct"),
        F.when(ok, amount_match(amount, true("amount_disputed"))).otherwise(False).alias("amount_correct"),
    )
    return scored.withColumn("field_accuracy", F.col("n_correct") / len(REQUIRED_FIELDS))


def model_scores(scored: DataFrame, model: str = "model") -> DataFrame:
    """Mean accuracy and JSON rate per model."""
    return scored.groupBy(model).agg(
        F.avg("field_accuracy").alias("avg_field_accuracy"),
        F.avg(F.col("json_valid").cast("int")).alias("json_parse_rate"),
        F.count("*").alias("n_samples"),
    )


def model_comparison(scores: DataFrame, baseline: str, candidate: str, model: str = "model") -> DataFrame:
    """Deltas of two models' aggregates, and whether the candidate is better."""
    pick = lambda name, column: F.max(F.when(F.col(model) == name, F.col(column)))
    wide = scores.agg(
        pick(baseline, "avg_field_accuracy").alias("baseline_accuracy"),
        pick(candidate, "avg_field_accuracy").alias("candidate_accuracy"),
        pick(baseline, "json_parse_rate").alias("baseline_json_rate"),
        pick(candidate, "json_parse_rate").alias("candidate_json_rate"),
        pick(candidate, "n_samples").alias("n_samples"),
    )
    delta = F.col("candidate_accuracy") - F.col("baseline_accuracy")
    return wide.select(
        "*",
        delta.alias("accuracy_delta"),
        (F.col("candidate_json_rate") - F.col("baseline_json_rate")).alias("json_rate_delta"),
        (delta > 0).alias("improved"),
    )
