"""Linguistic counts, token sets, codes and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A public English stop-word list of 179 words.
STOP_WORDS = "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't".split()
# Action verbs, in past forms.
ACTION_VERBS = "led managed built developed designed created launched delivered drove improved increased decreased reduced optimized implemented established spearheaded oversaw coordinated architected deployed scaled mentored negotiated authored directed generated transformed".split()
# Importance labels and their weights.
IMPORTANCE = {"not important": 1.0, "somewhat important": 2.0, "important": 3.0, "very important": 4.0, "extremely important": 5.0}


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def capitals(tokens: Column) -> Column:
    """How many tokens of two signs or more have letters, all upper case."""
    return F.size(F.filter(tokens, lambda w: (F.length(w) > 1) & w.rlike("[A-Z]") & ~w.rlike("[a-z]")))


def hapaxes(tokens: Column) -> Column:
    """How many distinct tokens stand once: in sorted order, those that differ from both neighbours."""

    def alone(s):
        return F.size(F.filter(s, lambda w, i: ~F.coalesce(F.get(s, i - 1) == w, F.lit(False)) & ~F.coalesce(F.get(s, i + 1) == w, F.lit(False))))

    # as an element of an array, the sorted list is made once and not for each token
    return F.get(F.transform(F.array(F.array_sort(tokens)), alone), 0)


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens of [a-z0-9]."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays without repeats; 0 if both are empty."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def coverage(wanted: Column, held: Column) -> Column:
    return ratio(F.size(F.array_intersect(wanted, held)), F.size(wanted))


def bigrams(tokens: Column) -> Column:
    """Distinct pairs of neighbours, in the order of the text."""
    return F.array_distinct(F.filter(F.transform(tokens, lambda w, i: F.concat_ws(" ", w, F.get(tokens, i + 1))), lambda p: p.contains(" ")))


def labels_match(a: Column, b: Column, least: float = 0.8, length_share: float = 0.5) -> Column:
    """One's tokens lie within the other's and are at least length_share as many, or the Jaccard share reaches least."""
    n, m = F.size(a), F.size(b)
    inside = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    return (n > 0) & (m > 0) & ((inside & (ratio(F.least(n, m), F.greatest(n, m)) >= length_share)) | (jaccard(a, b) >= least))


def strings_match(a: Column, b: Column, least: float = 0.5) -> Column:
    """One's sorted tokens as a string lie within the other's, or the Jaccard share reaches least."""
    x, y = (F.array_join(F.array_sort(t), " ") for t in (a, b))
    return (F.size(a) > 0) & (F.size(b) > 0) & (x.contains(y) | y.contains(x) | (jaccard(a, b) >= least))


def importance_label(value: Column) -> Column:
    """The label of the band that value lies in, upper ends included; an empty one outside 0 ... 5."""
    out = F.when((value < 0) | (value > 5) | value.isNull(), "")
    for top, name in enumerate(IMPORTANCE, 1):
        out = out.when(value <= top, name)
    return out.otherwise("")


def importance_level(value: Column) -> Column:
    """The label of the highest band whose lower end value exceeds; the lowest label otherwise, and null without a value."""
    names = list(IMPORTANCE)
    out = F.when(value.isNull(), None)
    for low in range(len(names) - 1, 0, -1):
        out = out.when(value > low, names[low])
    return out.otherwise(names[0])


def importance_weight(label: Column, default: float = 3.0) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in IMPORTANCE.items() for x in kv)), F.lower(label)), F.lit(default))


def short_batch(name: Column) -> Column:
    """Batch names of over ten characters as the first eight of their MD5."""
    return F.when(F.length(name) > 10, F.substring(F.md5(name), 1, 8)).otherwise(name)


def encoded_id(custom_id: Column) -> Column:
    """URL-safe Base64 without padding."""
    return F.rtrim(F.translate(F.translate(F.base64(F.encode(custom_id, "UTF-8")), "+/\r\n", "-_"), "=", " "))


def decoded_id(code: Column) -> Column:
    padded = F.rpad(code, ((F.length(code) + 3) / 4).cast("int") * 4, "=")
    return F.decode(F.unbase64(F.translate(padded, "-_", "+/")), "UTF-8")


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4).cast("int"))


def signal_first(info: Column, text: Column) -> Column:
    return F.when(F.coalesce(info, F.lit("")) == "", text).otherwise(F.concat(info, F.lit("\n\n"), text))


def model_of(run_name: Column, models: list[str], default: str = "unknown") -> Column:
    """The first of models that the run's name holds."""
    out = F.when(F.lit(False), "")
    for m in models:
        out = out.when(F.lower(run_name).contains(m), m)
    return out.otherwise(default)


def failure_category(error: Column, answered: Column | None = None) -> Column:
    """token_limit, content_filter, http_error or other_error by the text of an error; success without one; missing where there is no answer."""
    out = F.when(~answered, "missing") if answered is not None else F.when(F.lit(False), "")
    out = out.when(F.coalesce(error, F.lit("")) == "", "success")
    out = out.when(error.contains("Token limit") | error.contains("max_output_tokens"), "token_limit").when(F.lower(error).contains("content_filter"), "content_filter")
    return out.when(error.contains("HTTP"), "http_error").otherwise("other_error")


def belongs_to_run(file: Column, run_name: Column) -> Column:
    """The file's name begins with the run's, followed by _ or a dot."""
    return file.startswith(run_name) & F.substring(file, F.length(run_name) + 1, F.lit(1)).isin("_", ".")


def safe_double(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def model_id(name: Column, known: dict[str, str]) -> Column:
    """The id that a short name stands for, or the name itself."""
    out = F.when(F.lit(False), "")
    for short, full in known.items():
        out = out.when(name == short, full)
    return out.otherwise(name)


def short_model(model: Column) -> Column:
    """A short name from a model's id: what follows its last slash, in lower case, other signs as underscores."""
    return F.regexp_replace(F.lower(F.element_at(F.split(model, "/"), -1)), "[^a-z0-9]+", "_")


def short_style(style: Column) -> Column:
    """The first letters of a style's parts, which underscores and dashes divide."""
    return F.array_join(F.transform(F.filter(F.split(F.lower(style), "[_-]+"), lambda x: x != ""), lambda x: F.substring(x, 1, 1)), "")


def id_prefix(label: Column) -> Column:
    """The lower-case letters and digits of a class label."""
    return F.regexp_replace(F.lower(label), "[^a-z0-9]", "")


def node_lines(nodes: Column, offset: int = 0, header: str = "") -> Column:
    """label[ENTi:type] of each node (struct<label, type>), one a line and numbered from offset, below a header."""
    lines = F.transform(nodes, lambda n, i: F.concat(n["label"], F.lit("[ENT"), (i + offset).cast("string"), F.lit(":"), n["type"], F.lit("]")))
    return F.array_join(F.concat(F.array(F.lit(header)), lines) if header else lines, "\n")


def rendered(template: str, **values: Column) -> Column:
    """template with each {{ name }} as the column of that name, null as nothing."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{ " + name + " }}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def json_safe(value: Column) -> Column:
    """A double without NaN and infinities, which JSON lacks."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
