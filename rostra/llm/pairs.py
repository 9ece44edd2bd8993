"""Defects of prompt and response pairs: noisy labelling functions combined by an expectation-maximisation label model.

How far each function is to be trusted is learnt: from all answers, whose defects are not known, and from a bounded sample
of them into which defects were planted. Cutoffs are validated on a part of the planted answers that the model never saw.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.runtime import checkpointed, map_rows, small_rows

DEFECTS = ("empty", "copy", "refusal", "truncated", "language")
#: Labelling functions of each defect; every one votes 1 (defect), -1 (none) or 0 (abstains). Each looks at something else.
FUNCTIONS = {
    "empty": ("blank", "no_words", "reported"),
    "copy": ("contained", "opens_alike", "no_answer"),
    "refusal": ("declines", "first_person", "no_answer", "no_theme"),
    "truncated": ("open_json", "no_stop", "part_item", "limit_hit"),
    "language": ("prose_differs", "script_differs", "verdict_differs"),
}
NAMES = tuple(dict.fromkeys(f for fs in FUNCTIONS.values() for f in fs))
#: Share of answers in which each defect is expected at first, and answers that this counts for; answers at most that
#: defects are planted in; what all answers together count for beside the planted ones, at every size; cutoffs tried.
PRIOR, HOLD, SAMPLE, WEIGHT, CUTOFFS = 0.04, 500, 1500, 3000, tuple(i / 20 for i in range(2, 19))
SALT = "rostra-pairs-1"
# Answers that decline, and answers with nothing in them, to be planted.
DECLINED = (
    "I'm sorry, but I can't help with that.", "I must decline to judge this passage.", "As an AI model I am not able to assess political speeches.",
    "This request falls outside what I may do.", "I would rather not answer this question.", "Je regrette, je ne peux pas répondre à cette demande.",
    "Leider kann ich diese Frage nicht beantworten, ich kann keine Bewertung geben.", "Lo siento, no puedo responder a esta pregunta.", "Mae'n ddrwg gen i, ni allaf ateb.", "Я не могу ответить на этот вопрос.",
)
HOLLOW = ("", "   ", "```json\n```", "\u200b\u200b", "{}", "\"\"", "```\n{}\n```", "\n\n")

_INVISIBLE = re.compile(r"[\s ​-‏‪-‮⁠-⁯﻿\xad᠎\x00-\x1f]+")
_HOLLOW = re.compile(r"^(?:```\w*|[`'\"“”‘’„«»{}\[\]()<>.,:;\-_*#|~/\\]|json|null)*$", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_FENCE = re.compile(r"```\w*")
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d+[.)])\s+(.*\S)\s*$")
_VERDICT = re.compile(r"^\W*(yes|no|oui|non|ja|nein|sí|si|ydy|nac ydy|nac ydyw|nage|да|нет|ναι|όχι|نعم|لا|हाँ|हां|नहीं|是|否|是的|不是|はい|いいえ|ใช่|ไม่)(?!\w)", re.I)
_END = re.compile(r"[.!?。！？।؟;…»”\"')\]}`」]\s*$")
_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|\"[^\"]*\"|(?<![\w])‘(?:[^’]|’(?=\w))*’|(?<![\w])'(?:[^']|'(?=\w))*'(?!\w)|(?<=, )« [^»]* »(?=,)")
_DECLINE = re.compile(
    r"\b(?:declin(?:e|ed|ing)|refus(?:e|ed|ing)|refrain|unable to|not able to|(?:can ?not|can['’]t|could not|won['’]t|will not)(?: be able to)? (?:help|assist|answer|comply|provide|analyse|analyze|judge|rate|discuss|label|do|process|read|offer|give|complete|fulfil|share|support|classify)"
    r"|guidelines|not (?:be )?(?:appropriate|permitted|allowed|possible)|(?:permitted|allowed) to|would rather not|prefer not|falls outside|outside (?:my|what)|no verdict|against (?:my|the) (?:policy|rules)"
    r"|je (?:ne peux|refuse|suis dans l['’]impossibilité)|ne puis|impossible de (?:répondre|traiter)|ich kann (?:nicht|keine|das nicht|dabei nicht)|nicht möglich|lehne|no puedo|me niego|no es posible|ni allaf|gwrthod|ni fedraf|не могу|отказ)",
    re.I,
)
_FIRST = re.compile(r"\b(?:I|my|I['’]m|je|ich|yo|ni allaf)\b|\b(?:as an? (?:AI|language|assistant))", re.I)
# Frequent function words that tell languages of the Latin script apart.
FUNCTION_WORDS = {
    "en": "the of and is to in that was for which had this with from by not only who should wants mainly mention made most passage before about links speaker nothing beyond see any then leaves its their are be under on or does whether".split(),
    "fr": "le la les des du de et est une un que qui dans pour avec sur par pas ne aux au dit ce cette quand sans selon contre fin avant toute tout soit l d s n été veut".split(),
    "de": "der die das und ist ein eine einen des dem den nicht mit von zu im am als sich auf für nach warum aus ohne jede wurde wir ob sagte rief dass vor trotz zum etwa".split(),
    "es": "el la los las de del y es un una que en por con para no se su al dijo cuando sin según afirma fin antes todo unas tras contra pese quiere".split(),
    "cy": "y yr yn a ar ac i o gan am gyda trwy er heb sef ôl cyn pam na mae yw ei wedi nid fod dros hynny mawr".split(),
}
_KNOWS = {w: [lang for lang, ws in FUNCTION_WORDS.items() if w in ws] for ws in FUNCTION_WORDS.values() for w in ws}
SCRIPTS = (("cyrillic", "Ѐ-ӿ"), ("greek", "Ͱ-Ͽἀ-῿"), ("arabic", "؀-ۿ"), ("devanagari", "ऀ-ॿ"), ("cjk", "぀-ヿ㐀-鿿"), ("thai", "฀-๿"), ("hangul", "가-힯"), ("hebrew", "֐-׿"))
_SCRIPTS = [(n, re.compile(f"[{r}]")) for n, r in SCRIPTS]
_YES_NO = {"yes": "en", "oui": "fr", "non": "fr", "ja": "de", "nein": "de", "sí": "es", "si": "es", "ydy": "cy", "nac ydy": "cy", "nac ydyw": "cy", "nage": "cy", "да": "cyrillic", "нет": "cyrillic"}


def language(text: str) -> str | None:
    """Script of a text if it is mostly not Latin, else its language by function words; None if there is too little."""
    letters = len("".join(_WORDS.findall(text)))
    if not letters:
        return None
    for name, pattern in _SCRIPTS:
        if len(pattern.findall(text)) * 5 > letters * 2:
            return name
    scores = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in _WORDS.findall(text.lower()):
        for lang in (known := _KNOWS.get(w, ())):
            scores[lang] += 1 / len(known)
    (top, best), (_, second) = sorted(scores.items(), key=lambda x: -x[1])[:2]
    return top if best >= 1.5 and best >= 1.5 * second else None


def _json_open(body: str) -> int:
    """1: an object or list was begun and never closed; -1: all closed; 0: there is none."""
    depth, quoted, skip, any_ = 0, False, False, False
    for c in body:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"' and depth:
            quoted = True
        elif c in "{[":
            depth, any_ = depth + 1, True
        elif c in "}]":
            depth -= 1
    return 0 if not any_ else 1 if depth > 0 or quoted else -1


def _grams(words: list[str], n: int) -> set[tuple]:
    return set(zip(*(words[i:] for i in range(n))))


def votes(prompt: str | None, text: str | None, finish: str | None, error: str | None, tongues: dict | None = None) -> tuple[dict[str, int], str | None]:
    """Votes of the labelling functions on one pair, and the last item of a list that ends the answer, to be judged by the corpus.

    ``tongues`` remembers the languages of tasks, which many prompts share.
    """
    v = dict.fromkeys(NAMES, 0)
    raw = text or ""
    body = _INVISIBLE.sub(" ", raw).strip()
    bare = body.replace(" ", "")
    blank = _HOLLOW.match(bare) is not None
    v["blank"] = 1 if blank else -1
    words = _WORDS.findall(body.lower())
    v["no_words"] = 1 if len([w for w in words if w not in ("json", "null")]) == 0 else -1
    v["reported"] = 1 if error and not raw else 0
    if blank:
        return v, None
    stripped = _FENCE.sub("", raw).strip()
    is_json = stripped[:1] in "{[" or '"mentions_topic"' in stripped or "'mentions_topic'" in stripped
    at = stripped.find("{")
    keyed = re.search(r"[\"']mentions_topic[\"']\s*:", stripped) is not None
    lines = [x for x in raw.splitlines() if x.strip(" `​")]
    items = [m[1] for x in lines if (m := _ITEM.match(x))]
    verdict = _VERDICT.match(body)
    prose = " ".join(x for x in lines if not _ITEM.match(x)) if not is_json else ""
    if is_json:
        said = [m[1] for m in re.finditer(r"[\"'](?:explanation|reason|error|message|comment|note)[\"']\s*:\s*\"((?:[^\"\\]|\\.)*)", stripped)]
        prose = " ".join(said).replace('\\"', '"')
        if at > 0:
            lead = stripped[:at].strip()
    free = _VERDICT.sub("", prose, count=1).strip(" .,:;") if verdict else prose
    own = _QUOTED.sub(" ", free)
    # copy
    theirs = _WORDS.findall(prompt.lower()) if prompt and not is_json and len(words) >= 4 else []
    if theirs:
        mine = _grams(words, 3)
        share = len(mine & _grams(theirs, 3)) / len(mine) if mine else 0.0
        v["contained"] = 1 if share >= 0.6 else -1
        v["opens_alike"] = 1 if len({*words[:8]} & {*theirs}) >= min(8, len({*words[:8]})) - 1 and share >= 0.4 else -1
    else:
        v["contained"] = v["opens_alike"] = -1
    answered = keyed or verdict is not None or bool(items)
    v["no_answer"] = -1 if answered else 1
    # refusal
    v["declines"] = 1 if _DECLINE.search(own) and not re.search(r"cannot see any|can not see any", own) else -1 if answered else 0
    v["first_person"] = 1 if _FIRST.search(own) and not answered else 0
    v["no_theme"] = -1 if items or re.search(r"subthemes[\"']\s*:\s*\[\s*\"", stripped) else 0 if answered else 1
    # truncated
    last = None
    if is_json or at >= 0 and keyed:
        v["open_json"] = _json_open(stripped[max(at, 0):] if at >= 0 else stripped)
    elif lines:
        tail = lines[-1].rstrip(" \t​﻿")
        m = _ITEM.match(tail)
        if m:
            last = m[1].strip().lower()
        elif re.fullmatch(r"\s*(?:[-*•–]|\d+[.)])\s*", tail):
            v["part_item"] = 1
        else:
            cut = tail.endswith(("…", "...")) or not _END.search(tail)
            short = verdict is not None and len(lines) == 1 and verdict.end() >= len(body.rstrip(" ."))
            v["no_stop"] = -1 if short or not cut else 1
            if tail.endswith((":", ",")) and (short or len(lines) == 1 and len(words) <= 2):
                v["no_stop"] = 1
    v["limit_hit"] = 1 if finish in ("length", "max_tokens") else 0
    # language
    task = re.split(r"\n\s*\n", prompt or "", maxsplit=1)[0]
    tongues = {} if tongues is None else tongues
    if task not in tongues:
        tongues[task] = language(task)
    asked = tongues[task]
    spoken = language(own)
    if asked and spoken:
        v["prose_differs"] = 1 if asked != spoken else -1
        odd = {n for n, _ in _SCRIPTS}
        v["script_differs"] = (1 if spoken != asked else -1) if spoken in odd or asked in odd else 0
    if asked and verdict and not is_json and verdict[1].lower() in _YES_NO:
        v["verdict_differs"] = 1 if _YES_NO[verdict[1].lower()] != asked else -1
        if asked == "es" and verdict[1].lower() == "no":
            v["verdict_differs"] = -1
        if not spoken and v["verdict_differs"] == 1 and verdict[1].lower() != "no":
            v["prose_differs"] = 1
    return v, last


def planted(rows: list[tuple]) -> list[tuple[str, bool, tuple]]:
    """Answers with a defect planted in each, and the answers as they are: (defect or '', held out?, pair).

    Every fourth answer is held out. What is planted depends on the answer's place in the sample alone.
    """
    out = []
    for n, (prompt, text, finish, error) in enumerate(rows):
        rng, held = random.Random(f"{SALT}|{n}"), n % 4 == 3
        out.append(("", held, (prompt, text, finish, error)))
        out.append(("empty", held, (prompt, rng.choice(HOLLOW), finish, error)))
        out.append(("refusal", held, (prompt, rng.choice(DECLINED), finish, error)))
        if len(prompt) > 80:
            body = re.split(r"\n\s*\n", prompt)
            words = rng.choice([prompt, max(body, key=len)]).split()
            out.append(("copy", held, (prompt, " ".join(w for w in words if rng.random() > 0.03), finish, error)))
        at = int(len(text) * rng.uniform(0.3, 0.9))
        while 0 < at < len(text) and not (text[at - 1].isalnum() and text[at].isalnum()):
            at -= 1
        if at > 12:
            out.append(("truncated", held, (prompt, text[:at], rng.choice([finish, "length"]), error)))
        tongue = language(re.split(r"\n\s*\n", prompt, maxsplit=1)[0])
        other = rows[rng.randrange(len(rows))]
        if tongue and (theirs := language(re.split(r"\n\s*\n", other[0], maxsplit=1)[0])) and theirs != tongue:
            out.append(("language", held, (prompt, other[1], finish, error)))
    return out


def fit(patterns: Mapping[tuple[int, ...], float], known: Mapping[tuple[tuple[int, ...], bool], int], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Posterior of the defect for each pattern of votes, by expectation-maximisation over patterns and their counts.

    Given the defect, functions vote independently; each has a chance of each vote under defect and under none, learnt from
    the patterns and from the ``known`` ones: the planted count as what they are, the others begin the model. The counts of
    patterns are all the model sees, at most three to the power of the functions. All answers count for ``WEIGHT``, so that
    what was planted holds the classes in place in a table of any size: free of it, the likelihood of a large one is
    greater with classes that are no defects.
    """
    total = WEIGHT
    scale = WEIGHT / (sum(patterns.values()) or 1)
    patterns = {p: n * scale for p, n in patterns.items()}
    every = {*patterns, *(p for p, _ in known)}
    size = len(next(iter(every), ()))
    labelled = {(i, y, s): sum(n for (p, z), n in known.items() if z == y and p[i] == s) for i in range(size) for y in (True, False) for s in (1, 0, -1)}
    post, share = dict.fromkeys(every, 0.0), PRIOR
    for turn in range(rounds):
        chance = {}
        for i in range(size):
            for y in (True, False):
                # Answers as they are only show how the model begins, less the share of them that is expected to have the defect.
                mass = {s: 0.5 + (labelled[i, y, s] if y or not turn else 0) for s in (1, 0, -1)}
                if not y and not turn:
                    mass[1] = max(0.5, mass[1] - PRIOR * sum(mass.values()))
                for p, n in patterns.items() if turn else ():
                    mass[p[i]] += n * (post[p] if y else 1 - post[p])
                whole = sum(mass.values())
                chance.update({(i, y, s): m / whole for s, m in mass.items()})
        new = {}
        for p in every:
            odds = math.log(share / (1 - share)) + sum(math.log(chance[i, True, s] / chance[i, False, s]) for i, s in enumerate(p) if s)
            new[p] = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
        moved = max((abs(new[p] - post[p]) for p in every), default=0.0)
        post = new
        share = min(0.3, max(1e-4, (sum(post[p] * n for p, n in patterns.items()) + PRIOR * HOLD) / (total + HOLD)))
        if turn and moved < 1e-6:
            break
    return post


def cutoff(post: Mapping[tuple[int, ...], float], held: Mapping[tuple[tuple[int, ...], bool], int]) -> float:
    """The cutoff with the best hit rate less false alarms on held-out answers, of equal ones the nearest to a half.

    Some of the answers as they are have the defect too; these count against every cutoff alike.
    """
    sums = {y: sum(n for (_, z), n in held.items() if z == y) or 1 for y in (True, False)}
    rate = lambda c, y: sum(n for (p, z), n in held.items() if z == y and post[p] > c) / sums[y]
    return max(CUTOFFS, key=lambda c: (round(rate(c, True) - rate(c, False), 6), -abs(c - 0.5)))


def _judge(prompt: str | None, text: str | None, finish: str | None, error: str | None, tongues: dict) -> tuple[str | None, list[str], list[int]]:
    v, last = votes(prompt, text, finish, error, tongues)
    inner = []
    if text:
        found = [m[1].strip().lower() for x in text.splitlines() if (m := _ITEM.match(x))]
        listed = re.search(r"subthemes[\"']\s*:\s*\[([^\]]*)\]", text)
        inner = [*found[:-1], *(found[-1:] if last is None else []), *(x.strip().lower() for x in re.findall(r"\"([^\"]*)\"", listed[1] if listed else ""))]
    return last, inner, [v[n] for n in NAMES]


def labelled(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Votes for each call (call_id, one column for each labelling function), judged over all calls, and items known whole."""

    def judge(batch: Iterator[tuple]) -> Iterator[tuple]:
        tongues: dict = {}
        for key, prompt, text, finish, error in batch:
            last, inner, said = _judge(prompt, text, finish, error, tongues)
            yield (key, last, inner, *said)

    kind = df.schema["call_id"].dataType.simpleString()
    rows = df.select("call_id", "prompt_text", "text", "finish_reason", "error")
    # Rows that come again have the same votes: these are moved, not the texts.
    judged = checkpointed(map_rows(rows, judge, f"call_id {kind}, last string, inside array<string>, " + ", ".join(f"{n} byte" for n in NAMES)).distinct())
    # An item that other answers list before their last item is whole.
    whole = checkpointed(judged.select(F.explode("inside").alias("last")).groupBy("last").agg(F.count("*").alias("seen")).filter("seen >= 3").select("last"))
    out = judged.drop("inside").join(whole.withColumn("seen", F.lit(True)), "last", "left")
    part = F.when(F.col("last").isNull(), F.col("part_item")).when(F.col("seen").isNull(), 1).otherwise(-1).cast("byte")
    return out.withColumn("part_item", part).drop("last", "seen"), whole


def _planted_patterns(df: DataFrame, whole: DataFrame) -> dict[tuple[str, bool], Counter]:
    """Patterns of votes on planted answers, by defect and held out or not: (pattern, planted?) -> count."""
    spark = df.sparkSession
    some = df.select("call_id", "prompt_text", "text", "finish_reason", "error").filter("length(prompt_text) > 0 and length(trim(text)) > 0")
    at = F.md5(F.concat(F.col("call_id").cast("string"), F.lit(f"|{SALT}")))
    rows = some.orderBy(at, "call_id", "text").limit(SAMPLE).collect()
    cases = planted([tuple(r)[1:] for r in rows])
    tongues: dict = {}
    judged = [(defect, held, *_judge(*pair, tongues)) for defect, held, pair in cases]
    asked = {last for _, _, last, _, _ in judged if last is not None}
    known = {r[0] for r in spark.createDataFrame([(x,) for x in asked], "last string").join(whole, "last", "left_semi").collect()} if asked else set()
    part = NAMES.index("part_item")
    out: dict[tuple[str, bool], Counter] = {(d, h): Counter() for d in DEFECTS for h in (True, False)}
    for defect, held, last, _, said in judged:
        if last is not None:
            said[part] = -1 if last in known else 1
        for d in DEFECTS:
            if defect in ("", d):
                out[d, held][tuple(said[NAMES.index(f)] for f in FUNCTIONS[d]), defect == d] += 1
    return out


def defects(df: DataFrame) -> DataFrame:
    """Posteriors of defective pairs: (call_id, defect, p), all labels whose posterior exceeds the cutoff of their defect.

    Null and blank answers are 'empty'; a null prompt leaves copy and language open. Repeated rows are judged once, rows
    that differ under one call_id each by itself; other columns are ignored; an empty table gives an empty one. Votes are
    counted and the model is fitted when this is called.
    """
    marked, whole = labelled(df)
    marked = checkpointed(marked)
    spark = df.sparkSession
    # One scan counts the vote patterns of all defects.
    sets = F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.concat_ws(",", *(F.col(f).cast("string") for f in FUNCTIONS[d])).alias("pattern")) for d in DEFECTS)))
    long = marked.select("call_id", sets.alias("x")).select("call_id", "x.*")
    bound = sum(3 ** len(f) for f in FUNCTIONS.values())
    counted = small_rows(long.groupBy("defect", "pattern").agg(F.count("*").alias("n")), bound, "vote patterns")
    seeds = _planted_patterns(df, whole)
    fitted = []
    for d in DEFECTS:
        patterns = {tuple(map(int, r["pattern"].split(","))): r["n"] for r in counted if r["defect"] == d}
        post = fit(patterns, seeds[d, False])
        for p, _ in seeds[d, True]:
            post.setdefault(p, 0.0)
        least = cutoff(post, seeds[d, True])
        fitted += [(d, ",".join(map(str, p)), float(post[p])) for p in patterns if post[p] > least]
    kept = spark.createDataFrame(fitted, "defect string, pattern string, p double")
    return long.join(F.broadcast(kept), ["defect", "pattern"]).groupBy("call_id", "defect").agg(F.max("p").alias("p"))


def found(df: DataFrame) -> DataFrame:
    """At most one defect for each call: (call_id, defect); of several, the first in the order of ``DEFECTS``."""
    rank = F.array_position(F.lit(list(DEFECTS)), F.col("defect"))
    return defects(df).groupBy("call_id").agg(F.min_by("defect", rank).alias("defect"))
