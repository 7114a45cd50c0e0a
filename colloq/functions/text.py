"""Text functions as column expressions; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloq.functions.expressions import let

WORD = r"[\p{L}\p{N}_]"

# Response patterns and cue lists of the customer-support domain.
PATTERNS = {
    "asks_dm": r"\b(dm us|dm me|direct message|send us a (direct )?message|pm us|private message|message us|message our|write to us|write us|reach out to us|reach out to our|inbox us|contact us on (twitter|dm))\b",
    "help_context": r"help|troubleshoot|article|support page|/gp/help|customer service page",
    "support_link_context": r"reach (out )?(to )?us|contact us|here:|for assistance|more (info|information)|take a (further )?look|live support|phone or chat|send us",
    "any_url": r"https?://\S+|www\.\S+",
    "tracking": r"\b(tracking|track your|tracking id|track number)\b|track\.amazon|/gp/css/order|orderstatus|delivery-track",
    "phone": r"\+?1[-. ]?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}|\b\d{3}[-. ]\d{3}[-. ]\d{4}\b",
    "instruction": r"\b(please|kindly|could you|can you|you can|we ask|we recommend|we suggest|reach out|contact us|click|go to|visit|select|choose|update your|verify|sign in|sign into|let us know|check your)\b",
    "apology": r"\b(sorry|apologize|apologise|apologies|apologetic|regret|most sincerely)\b",
    "acknowledgement": r"\b(thank you for|thanks for|thank you for reaching|we understand|we appreciate|we'?re glad|we are glad|noted|well received|thanks for updating)\b",
    "account_privacy": r"\b(account|password|two[- ]step|verification|verify your identity|security code|sign[- ]in|personal information|privacy)\b",
    "resolved_claim": r"\b(resolved|fixed the issue|your issue has been (resolved|fixed)|we have (resolved|fixed))\b",
}
CUES = {
    "sorry": ("sorry", "apolog", "regret", "unfortunate"),
    "contact": ("contact", "message us", "reach out", "get in touch", "reply to this", "chat", "link", "email", "http", "applicable policy", "details and timeline"),
    "ask": ("order id", "order number", "provide", "please share", "email address", "preference"),
    "thank": ("thank", "welcome", "helpful"),
}
CUE_FEATURES = {
    "apology": ("sorry", "apolog", "regret"),
    "ask": ("order id", "order number", "please share", "provide", "email address"),
    "contact": ("contact", "message us", "get in touch", "reply to this", "chat", "reach out"),
}
RUBRIC = {
    "delivery_delay": r"\b(late|delay|not arriv|hasn.t arriv|out for delivery|no sign of|stuck|in transit|supposed.*deliver|delivery date)\b",
    "delivered_not_received": r"\b(mark.*delivered|says.*delivered|delivered.*but|delivered.*not receive|shows.*deliver|handed to resident)\b",
    "delivered_wrong": r"\b(wrong address|wrong house|neighbor|stolen|dumped|missed.*deliver)\b",
    "refund": r"\b(refund|money back|give back|reimburs)\b",
    "cancellation": r"\b(cancel(l)?ation|want to cancel|didn.t order)\b",
    "charge_issue": r"\b(charg|debited|unauthoriz|price went|double charged|billed)\b",
    "order_status": r"\b(where.*(order|package)|status of.*order|when.*(arrive|deliver|ship)|has my order)\b",
    "device_app": r"\b(echo|alexa|kindle|fire stick|fire tv|prime video|not (work|loading|playing)|app\b)\b",
    "return_replacement": r"\b(return|send back|exchange|replacement|faulty|damag|defect|broken)\b",
    "account_access": r"\b(log.?in|password|hack|suspended account|cannot.*account|forgot.*(email|password))\b",
    "account_info_update": r"\b(update.*(email|address|phone)|change.*(address|email|phone))\b",
    "service_complaint": r"\b(support.*(useless|bad|terrible|worst)|never (again|using)|fed up|sick of)\b",
}
DEICTIC = r"\b(it|this|that|still|again|what|okay|ok|thanks|thx)\b"
ANGRY = r"\b(wtf|hell|sick|fed up|useless|terrible|scam|worst|angry|furious|disgusting|never again)\b"
# What is taken out of a reply before it is reused.
REMOVED = {
    "urls": r"https?://\S+|t\.co/\S+",
    "phones": r"(?<!\d)(?:\+?\d[\d\s().-]{7,}\d)(?!\d)",
    "long ids": r"\b\d{13,17}\b",
    "handles": rf"@{WORD}+",
    "tags": r"\^[A-Za-z0-9]+",
}
MAX_CONTEXT_TURNS = 6


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """White space to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """URLs to URL, mentions to @USER, white space squeezed; null becomes empty."""
    return squeeze(F.regexp_replace(F.regexp_replace(_text(c), r"https?://\S+", "URL"), rf"@{WORD}+", "@USER"))


def canonical_template(c: Column) -> Column:
    """Lower case; URLs, mentions and numbers to placeholders; other punctuation to spaces."""
    t = F.regexp_replace(F.lower(_text(c)), r"https?://\S+", "URL")
    t = F.regexp_replace(t, rf"@{WORD}+", "@USER")
    t = F.regexp_replace(t, r"[0-9][0-9.,-]*", "#")
    return squeeze(F.regexp_replace(t, r"[^\p{L}\p{N}_\s@#-]", " "))


def normalised(c: Column) -> Column:
    """URLs, mentions and # removed, lower case."""
    return F.lower(F.regexp_replace(_text(c), rf"https?://\S+|@{WORD}+|#", " "))


def tokens(c: Column) -> Column:
    """Lower-case tokens of letters, digits, _, ' and -, without pure numbers and single characters."""
    found = F.regexp_extract_all(F.lower(_text(c)), F.lit(r"[\p{L}\p{N}_'-]+"), 0)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.rlike(r"^\p{Nd}+$"))


def tfidf_tokens(c: Column) -> Column:
    """Lower-case words of two or more word characters."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def forensic_tokens(c: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Runs of three or more a-z that are words of their own, without stop words."""
    found = F.regexp_extract_all(F.lower(_text(c)), F.lit(r"(?U)\b[a-z]{3,}\b"), 0)
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def parse_context(c: Column) -> Column:
    """'CUSTOMER: a | BRAND: b' to an array of (role, text); parts without a known prefix are lost."""
    parts = F.transform(F.split(_text(c), r"\|"), lambda p: F.trim(p))
    known = F.filter(parts, lambda p: F.upper(p).rlike(r"^(CUSTOMER|BRAND):"))
    return F.transform(known, lambda p: F.struct(F.lower(F.regexp_extract(p, r"(?i)^(customer|brand):", 1)).alias("role"), F.trim(F.regexp_replace(p, r"(?i)^(customer|brand):", "")).alias("text")))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat_ws(": ", role, text)


def context_and_message(message: Column, context: Column, turns: int = MAX_CONTEXT_TURNS) -> Column:
    """'Previous customer: …' lines of the first turns as given (nearest first), then the message."""
    said = F.filter(F.slice(F.coalesce(context, F.array().cast("array<struct<role:string,text:string>>")), 1, turns), lambda t: F.trim(_text(t["text"])) != "")
    label = lambda t: F.when(F.lower(F.trim(F.coalesce(t["role"], F.lit("customer")))) == "customer", F.lit("Previous customer: ")).otherwise(F.lit("Previous support: "))
    lines = F.transform(said, lambda t: F.concat(label(t), F.trim(t["text"])))
    return F.array_join(F.concat(lines, F.array(F.concat(F.lit("Current customer: "), _text(message)))), "\n")


def context_blocks(message: Column, context: Column, turns: int = MAX_CONTEXT_TURNS) -> Column:
    """The same with each label on a line of its own and blank lines between."""
    said = F.filter(F.slice(F.coalesce(context, F.array().cast("array<struct<role:string,text:string>>")), 1, turns), lambda t: F.trim(_text(t["text"])) != "")
    label = lambda t: F.when(F.lower(F.trim(t["role"])) == "customer", F.lit("Previous customer:\n")).otherwise(F.lit("Previous support:\n"))
    return F.array_join(F.concat(F.transform(said, lambda t: F.concat(label(t), F.trim(t["text"]))), F.array(F.concat(F.lit("Current customer:\n"), _text(message)))), "\n\n")


def document_text(message: Column, context: Column, include_context: bool) -> Column:
    return context_and_message(message, context) if include_context else _text(message)


def response_flags(c: Column) -> dict[str, Column]:
    """The twelve response-pattern flags; null and blank responses have none."""
    there = F.trim(_text(c)) != ""
    hit = {k: there & F.coalesce(c.rlike("(?i)" + p), F.lit(False)) for k, p in PATTERNS.items()}
    return {
        "has_response": there,
        "asks_dm": hit["asks_dm"],
        "contains_any_url": hit["any_url"],
        "contains_help_url": hit["any_url"] & hit["help_context"],
        "contains_support_link": hit["any_url"] & hit["support_link_context"],
        "contains_tracking_url": hit["tracking"],
        "contains_phone": hit["phone"],
        "contains_instruction": hit["instruction"],
        "contains_apology": hit["apology"],
        "contains_acknowledgement": hit["acknowledgement"],
        "account_or_privacy": hit["account_privacy"],
        "claims_resolved": hit["resolved_claim"],
    }


def flag_map(flags: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in flags.items() for x in (F.lit(k), v)])


def sanitize(c: Column) -> Column:
    """URLs, phone numbers, long ids, handles and ^tags removed; ends stripped of space and light punctuation."""
    t = _text(c)
    for pattern in REMOVED.values():
        t = F.regexp_replace(t, pattern, "")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ .,;-]+|[ .,;-]+$", "")


def _any_of(low: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | low.contains(w)
    return found


def cue(c: Column) -> Column:
    """The first of sorry, contact, ask, thank whose cues occur, else default."""

    def named(low: Column) -> Column:
        out = F.lit("default")
        for name in reversed(CUES):
            out = F.when(_any_of(low, CUES[name]), F.lit(name)).otherwise(out)
        return out

    return let(F.lower(_text(c)), named)


def cue_set(c: Column) -> Column:
    """Sorted names of the cue features of a text."""
    t, low = _text(c), F.lower(_text(c))
    flags = {"url": low.contains("http"), "email": t.contains("@") & t.contains(".") & ~low.startswith("@user")} | {k: _any_of(low, v) for k, v in CUE_FEATURES.items()}
    return F.array_sort(F.array_compact(F.array(*[F.when(f, F.lit(k)) for k, f in flags.items()])))


def content_words(c: Column) -> Column:
    """Distinct ASCII words of five or more letters, without http and tco."""
    found = F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z]{5,}"), 0)
    return F.array_distinct(F.filter(found, lambda w: ~w.rlike("^(http|tco)")))


def shares_words(a: Column, b: Column, at_least: int = 2) -> Column:
    return F.size(F.array_intersect(content_words(a), content_words(b))) >= at_least


def loose_words(c: Column) -> Column:
    """White-space tokens of letters and digits only, longer than three."""
    return F.array_distinct(F.filter(F.split(F.lower(_text(c)), r"\s+"), lambda w: w.rlike(r"^[\p{L}\p{N}]+$") & (F.length(w) > 3)))


def rubric_hits(c: Column, rules: dict[str, str] = RUBRIC) -> Column:
    """Names of the keyword rules that match, in rule order."""
    low = F.lower(_text(c))
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in rules.items()]))


def rubric_bucket(c: Column, rules: dict[str, str] = RUBRIC) -> Column:
    return F.coalesce(F.get(rubric_hits(c, rules), F.lit(0)), F.lit("unmatched"))


def message_flags(c: Column) -> dict[str, Column]:
    low = F.lower(_text(c))
    return {"is_short": F.length(_text(c)) < 90, "is_deictic": low.rlike(DEICTIC), "is_angry": low.rlike(ANGRY)}


def in_pool(c: Column, rules: dict[str, str] = RUBRIC) -> Column:
    """Whether a message is worth a person's label: short, pointing at something, angry, or without a rule that fits."""
    flags = message_flags(c)
    return flags["is_short"] | flags["is_deictic"] | flags["is_angry"] | (rubric_bucket(c, rules) == "unmatched")


def id_shape(c: Column, own: Column) -> Column:
    """struct(commas, has_number, is_self, all_digits) of a field that should hold the id of another row."""
    t = _text(c)
    return F.struct(
        (F.size(F.split(t, ",")) - 1).cast("bigint").alias("commas"),
        t.rlike(r"[0-9]").alias("has_number"),
        F.coalesce(F.trim(t) == own.cast("string"), F.lit(False)).alias("is_self"),
        t.rlike(r"^\d+$").alias("all_digits"),
    )


def intent_input(message: Column, context: Column) -> Column:
    """What an intent classifier reads: the message, and its context on the next line if there is any."""
    return F.concat_ws("\n", _text(message), F.nullif(_text(context), F.lit("")))


def flat_context(context: Column, previous: Column) -> Column:
    """Context turns (role, text) line by line; without any, the brand's previous message."""
    lines = F.array_join(F.transform(context, lambda t: render_turn(F.upper(t["role"]), t["text"])), "\n")
    return F.when(F.size(context) > 0, lines).otherwise(_text(previous))


def shared_cues(a: Column, b: Column) -> Column:
    """Sorted names of the cue features that two texts have in common."""
    return F.array_sort(F.array_intersect(cue_set(a), cue_set(b)))


def is_low_content(c: Column) -> Column:
    return F.length(F.trim(F.replace(_text(c), F.lit("@USER"), F.lit("")))) < 8


def first_number(c: Column) -> Column:
    """The first run of digits as BIGINT; null if there is none or it does not fit."""
    return F.expr("try_cast(nullif(regexp_extract(`{0}`, '([0-9]+)', 1), '') as bigint)".format(c)) if isinstance(c, str) else F.nullif(F.regexp_extract(c, "([0-9]+)", 1), F.lit("")).try_cast("bigint")


def first_nonempty(c: Column) -> Column:
    """The first element of an array that is neither null nor empty."""
    return F.get(F.filter(c, lambda x: x.isNotNull() & (x != "")), F.lit(0))


def strip_code_fence(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(_text(c)), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def grounded_body(c: Column, limit: int = 220) -> Column:
    """The sanitised reply, cut at the last space that leaves at most ``limit`` characters."""

    def shortened(body: Column) -> Column:
        short = F.regexp_extract(body, rf"^(?s)(.{{0,{limit}}})(?= )", 1)
        return F.when(F.length(body) <= limit, body).when(short != "", short).when(body.contains(" "), F.element_at(F.split(body, " "), 1)).otherwise(body)

    def finished(s: Column) -> Column:
        cut = s["cut"]
        return F.when((cut != s["text"]) & (cut != "") & ~cut.rlike(r"[.!?]$"), F.concat(cut, F.lit("."))).otherwise(cut)

    def both(text: Column) -> Column:
        body = let(F.regexp_replace(text, r"(?<=[.!?])\s+", " "), shortened)
        return let(F.struct(text.alias("text"), body.alias("cut")), finished)

    return let(sanitize(c), both)
