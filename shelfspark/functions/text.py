"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PRONOUNS = ("why", "and", "so", "it", "its", "they", "them", "this", "that", "those", "these", "he", "she")
LOCAL_ASKS = ("chapter", "section", "page ", "paragraph", "figure ", "table ")
WHOLE_ASKS = (
    "summariz", "summaris", "main point", "main theme", "main idea", "key idea", "key takeaway", "key point", "overview", "what is this book about",
    "what's this book about", "what is the book about", "tl;dr", "table of contents", "the whole book", "entire book", "gist of",
)
NO_CHAT = (
    "flux", "stable-diffusion", "sd3", "sdxl", "dall-e", "playground-v", "kandinsky", "-image", "image-", "embed", "whisper", "tts", "-audio",
    "rerank", "clip", "moderation", "-vae", "upscal", "controlnet", "guard",
)
FUSION_COSINE = 0.33
# What an answer without passages says, and what precedes one on a whole book.
NO_HITS = "I couldn't find any matching passages in the selected collection(s)."
WHOLE_CAVEAT = "*Heads up: this answers from a handful of retrieved passages, not the full text, so a whole-book summary can miss things. Ask about specific topics for the most reliable answers.*\n\n"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once; used where body is a lambda that would repeat it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def clean_text(text: Column) -> Column:
    """Join words hyphenated at line ends, collapse blanks and empty lines, trim."""
    t = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def norm_text(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, "­", ""), r"([0-9A-Za-z_])-\s+([0-9A-Za-z_])", "$1$2")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def norm_chapter(text: Column) -> Column:
    t = F.regexp_replace(norm_text(text), r"(?iu)^(?:chapter|глава|часть|part)\s+(?:\d+|[ivxlcdm]+)\.?:?\s+", "")
    t = F.regexp_replace(t, r"^[\d.]+\s*[.:—-]?\s*", "")
    return F.lower(F.regexp_replace(t, r"(?i)^[ivxlcdm]+\.\s+", ""))


def probe_of(text: Column) -> Column:
    """The first eight words in a row with two letters or more each, else the first eight."""
    wordy = lambda w: F.length(F.regexp_replace(w, r"\P{L}", "")) >= 2

    def run(words: Column, letters: Column) -> Column:
        starts = F.when(F.size(words) >= 8, F.sequence(F.lit(1), F.size(words) - 7)).otherwise(F.array().cast("array<int>"))
        fit = F.filter(starts, lambda i: F.forall(F.slice(letters, i, 8), lambda x: x))
        return F.array_join(F.slice(words, F.coalesce(F.try_element_at(fit, F.lit(1)), F.lit(1)), F.lit(8)), " ")

    return let(F.split(norm_text(text), " "), lambda words: let(F.transform(words, wordy), lambda letters: run(words, letters)))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def strip_markers(text: Column) -> Column:
    return F.regexp_replace(text, r"\[[0-9, ]*[0-9][0-9, ]*\]", "")


def estimate_tokens(text: Column) -> Column:
    n, cyrillic = F.length(text), F.regexp_count(text, F.lit("[Ѐ-ӿ]"))
    return F.when(n == 0, 0).when(cyrillic * 5 >= n, F.ceil(n / F.lit(2.5))).otherwise(F.ceil(n / F.lit(4.0))).cast("long")


def pronoun_led(question: Column) -> Column:
    first = F.coalesce(F.try_element_at(words_of(question), F.lit(1)), F.lit(""))
    return F.lower(F.regexp_replace(first, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).isin(*PRONOUNS)


def fuse_followup(question: Column, cosine: Column) -> Column:
    n = F.size(words_of(question))
    near = F.coalesce(cosine >= FUSION_COSINE, F.lit(False))
    return F.when(n == 0, False).when(n <= 3, True).when((n <= 12) & pronoun_led(question), True).otherwise(near)


def is_aggregative(question: Column) -> Column:
    low = F.lower(question)
    return ~contains_any(low, LOCAL_ASKS) & contains_any(low, WHOLE_ASKS)


def is_chat_model(name: Column) -> Column:
    return ~contains_any(F.lower(name), NO_CHAT)


def normalize_title(title: Column) -> Column:
    spaced = F.translate(F.lower(title), "_-.():,/", "        ")
    keep = lambda w: ~(w.isin("meap", "edition", "final", "") | w.rlike("^[0-9]+$") | w.rlike("^[vb][0-9]+$"))
    return F.array_join(F.filter(F.split(spaced, r"\s+"), keep), " ")


def slugify(title: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(title, "[^0-9A-Za-z]+", "-"), "^-+|-+$", "")
    capped = F.regexp_replace(F.substring(F.lower(dashed), 1, 60), "^-+|-+$", "")
    return F.when(capped == "", F.lit("artifact")).otherwise(capped)


def yaml_quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def citation(title: Column, author: Column, chapter: Column, page: Column, family: Column, loc: Column) -> Column:
    head = F.concat(title, F.when(F.coalesce(author, F.lit("")) != "", F.concat(F.lit(" — "), author)).otherwise(F.lit("")))
    part = F.when(F.coalesce(chapter, F.lit("")) != "", F.concat(F.lit("Ch. "), chapter))
    paged = F.coalesce((family == "pdf") & page.isNotNull(), F.lit(False))
    place = F.when(paged, F.concat(F.lit("p."), page.cast("string"))).when(chapter.isNull(), F.concat(F.lit("~loc "), loc.cast("string")))
    where = F.concat_ws(", ", part, place)
    return F.when(where == "", head).otherwise(F.concat(head, F.lit(" · "), where))


def script_of(title: Column) -> Column:
    letters, cyrillic = F.regexp_count(title, F.lit(r"\p{L}")), F.regexp_count(title, F.lit("[Ѐ-ӿ]"))
    return F.when((letters > 0) & (cyrillic * 2 >= letters), F.lit("ru")).otherwise(F.lit("en"))


def line_norm(line: Column) -> Column:
    """Line for comparison: white space collapsed, lower case, digits as #. NFKC is left to the caller."""
    return F.regexp_replace(F.lower(one_line(line)), "[0-9]+", "#")


def is_noise_line(line: Column) -> Column:
    """Empty lines, page numbers and rules."""
    return one_line(line).rlike(r"^[0-9\s.·—–|-]*$")


def script_mix(text: Column) -> Column:
    """The share of words of three letters or more that mix Cyrillic and Latin."""
    words = F.filter(words_of(text), lambda w: F.length(w) >= 3)
    mixed = F.filter(words, lambda w: w.rlike("[Ѐ-ӿ]") & w.rlike("[A-Za-z]"))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.size(mixed) / F.size(words))


def cer(truth: Column, read: Column) -> Column:
    """Edit distance over the length of the truth, white space and case aside."""
    a, b = F.lower(one_line(truth)), F.lower(one_line(read))
    return F.when(a == "", F.when(b == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.lit(1)))


def word_recall(truth: Column, read: Column) -> Column:
    """The share of the truth's words of four letters or more that were read."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 4)
    share = lambda t, g: F.when(F.size(t) == 0, F.lit(1.0)).otherwise(F.size(F.filter(t, lambda w: F.array_contains(g, w))) / F.size(t))
    return let(words(truth), lambda t: let(F.array_distinct(words(read)), lambda g: share(t, g)))


def group_letter(name: Column) -> Column:
    first = F.upper(F.substring(F.trim(name), 1, 1))
    return F.when(first.rlike("^[A-ZА-ЯЁ]$"), first).otherwise(F.lit("#"))


def duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s))).otherwise(F.concat_ws(":", m.cast("string"), two(s)))


def json_array(text: Column) -> Column:
    """From the first [ to the last ], control characters as spaces; null without both."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(?s)(\[.*\])", 1), r"[\x00-\x1f]", " "), F.lit(""))


def stream_line(line: Column, provider: Column) -> Column:
    """struct(content, reasoning, in_tokens, out_tokens, done) of a line of a provider's answer stream: ollama, anthropic, or else OpenAI's form."""
    data = F.trim(F.regexp_extract(F.ltrim(line), r"(?s)^data:(.*)$", 1))
    body = F.when(provider == "ollama", F.trim(line)).when(data == "[DONE]", None).otherwise(F.nullif(data, F.lit("")))

    def read(x: Column) -> Column:
        text = lambda path: F.nullif(F.get_json_object(x["body"], path), F.lit(""))
        number = lambda path: F.get_json_object(x["body"], path).try_cast("long")
        row = lambda content, reasoning, read, wrote, done: F.struct(content.alias("content"), reasoning.alias("reasoning"), read.alias("in_tokens"), wrote.alias("out_tokens"), done.alias("done"))
        kind = text("$.type")
        delta = kind == "content_block_delta"
        ollama = row(text("$.response"), text("$.thinking"), number("$.prompt_eval_count"), number("$.eval_count"), F.coalesce(F.get_json_object(x["body"], "$.done") == "true", F.lit(False)))
        anthropic = row(F.when(delta, text("$.delta.text")), F.when(delta, text("$.delta.thinking")), F.when(kind == "message_start", number("$.message.usage.input_tokens")), F.when(kind == "message_delta", number("$.usage.output_tokens")), F.lit(False))
        thought = F.coalesce(text("$.choices[0].delta.reasoning_content"), text("$.choices[0].delta.reasoning"))
        openai = row(text("$.choices[0].delta.content"), thought, number("$.usage.prompt_tokens"), number("$.usage.completion_tokens"), x["data"] == "[DONE]")
        return F.when(x["provider"] == "ollama", ollama).when(x["provider"] == "anthropic", anthropic).otherwise(openai)

    return let(F.struct(body.alias("body"), data.alias("data"), provider.alias("provider")), read)


def progress_line(line: Column) -> Column:
    """struct(kind, title, chunks, path) of a helper's line: a book's, one of a skipped file, or another."""
    rest = F.trim(F.regexp_extract(F.trim(line), r"(?s)^\[[^\]]*\](.*)$", 1))
    ours, skip = F.trim(line).rlike(r"(?s)^\[[^\]]*\]"), rest.startswith("skip")
    title = F.when(rest.contains(": "), F.regexp_replace(rest, r"(?s)^(.*): .*$", "$1")).otherwise(rest)
    chunks = F.coalesce(F.regexp_extract(rest, r"(?s)^.*: \s*(\S+)", 1).try_cast("long"), F.lit(0).cast("long"))
    return F.struct(
        F.when(~ours, "other").when(skip, "skip").otherwise("book").alias("kind"),
        F.when(ours & ~skip, title).alias("title"),
        F.when(ours & ~skip, chunks).alias("chunks"),
        F.when(ours & skip, F.regexp_extract(rest, r"(\S*)$", 1)).alias("path"),
    )


def chat_error(status: Column, body: Column) -> Column:
    """What to tell the reader when a provider answers with an error status, and the beginning of what it said."""
    said = F.when(F.trim(body) == "", "").otherwise(F.concat(F.lit(": "), F.substring(F.trim(body), 1, 200)))
    code = F.concat(F.lit(" ("), status.cast("string"), F.lit(")"))
    say = lambda text, more: F.concat(F.lit(text), code, more)
    return (
        F.when(status.isin(401, 403), say("The key was refused, or this model cannot chat", said))
        .when(status == 404, say("The provider has no model of that name", said))
        .when(status == 400, say("The request was not accepted", said))
        .when(status == 429, say("Too many requests, wait a little", F.lit("")))
        .otherwise(say("The provider failed", said))
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def l2_normalize(a: Column) -> Column:
    size = norm(a)
    return F.when(size == 0, a.cast("array<double>")).otherwise(F.transform(a.cast("array<double>"), lambda x: x / size))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
