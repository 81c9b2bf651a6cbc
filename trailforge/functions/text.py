"""String functions as column expressions; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no weight in retrieval.
STOPWORDS = (
    "the and for are but not you all can had her was one our out has his how its may new now old see way who did get let say "
    "she too use that with have this will your from they been said each which their also into than them then what when were "
    "some would make like could other after about there these most more very"
).split()


def text_or_empty(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def plain_tokens(column: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits, repeats kept."""
    return F.regexp_extract_all(F.lower(text_or_empty(column)), F.lit("[a-z0-9]+"), 0)


def search_tokens(column: Column | str) -> Column:
    """Plain tokens of more than two characters that are no stopwords."""
    return F.filter(plain_tokens(column), lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS))


def long_words(column: Column | str) -> Column:
    """Distinct lower-case words of more than two characters between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(text_or_empty(column))), r"\s+"), lambda t: F.length(t) > 2))


def word_set(column: Column | str) -> Column:
    """Distinct words of letters, digits and underscores in any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(column)), F.lit(r"[\p{L}\p{N}_]+"), 0))


def normalize_answer(column: Column | str) -> Column:
    """Lower case, no articles, no ASCII punctuation, single spaces, in this order."""
    bare = F.regexp_replace(F.lower(text_or_empty(column)), r"\b(a|an|the)\b", " ")
    bare = F.regexp_replace(bare, r"\p{Punct}", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def last_answer(column: Column | str) -> Column:
    """The content of the last <answer> element, null if there is none."""
    return F.trim(F.try_element_at(F.regexp_extract_all(column, F.lit(r"(?s)<answer>(.*?)</answer>"), 1), F.lit(-1)))


def labelled_ids(column: Column | str) -> Column:
    """Entity ids after `ID:`, distinct and in order."""
    return F.array_distinct(F.regexp_extract_all(column, F.lit(r"ID:\s*(Q\d+)"), 1))


def any_ids(column: Column | str) -> Column:
    """All entity ids, distinct and in order."""
    return F.array_distinct(F.regexp_extract_all(column, F.lit(r"Q\d+"), 0))


def is_error(column: Column | str) -> Column:
    """Whether an observation speaks of an error."""
    return F.lower(text_or_empty(column)).rlike("error|invalid")


def head_and_tail(column: Column, limit: int, keep: int, marker: str) -> Column:
    """Long texts cut in the middle."""
    return F.when(F.length(column) > limit, F.concat(F.left(column, F.lit(keep)), F.lit(marker), F.right(column, F.lit(keep)))).otherwise(column)


def snippet(column: Column, size: int) -> Column:
    """The first characters and three dots where more follow (X11)."""
    return F.when(F.length(column) > size, F.concat(F.left(column, F.lit(size)), F.lit("..."))).otherwise(column)


def at_word(column: Column, size: int) -> Column:
    """Cut at the last space before size characters (X11)."""
    cut = F.left(column, F.lit(size))
    return F.when(F.length(column) > size, F.regexp_replace(cut, r"\s+\S*\z", "")).otherwise(column)


#: What a caption may start with and a hint leaves out.
CAPTION_PREFIXES = "A photo of |A photograph of |An image of |A picture of |Photo of |Image of |Picture of "


def caption_hint(column: Column, size: int = 60) -> Column:
    """A caption without its opening phrase, cut."""
    return at_word(F.regexp_replace(column, f"^({CAPTION_PREFIXES})", ""), size)


def fact_text(title: Column, caption: Column, context: Column, limit: int = 500) -> Column:
    """Title, caption and a short context with dashes between; blanks are left out."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.concat_ws(" — ", blank(title), blank(caption), F.when(F.length(F.trim(context)) < limit, blank(context)))


def index_text(*parts: Column) -> Column:
    """The parts of an index entry that are not blank, with bars between."""
    return F.concat_ws(" | ", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])


#: How a picture's file ends, by mime type and else by its address.
MIME_EXTENSIONS = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg"}


def file_extension(mime: Column, url: Column) -> Column:
    """By mime type, else by the address, else .jpg."""
    by_mime = F.coalesce(*[F.when(F.lower(mime) == k, F.lit(v)) for k, v in MIME_EXTENSIONS.items()])
    ending = F.regexp_extract(F.lower(F.regexp_replace(url, r"[?#].*$", "")), r"\.(jpg|jpeg|png|gif|webp|svg)$", 1)
    return F.coalesce(by_mime, F.when(ending == "jpeg", ".jpg"), F.when(ending != "", F.concat(F.lit("."), ending)), F.lit(".jpg"))


def english_words(column: Column | str) -> Column:
    """How many words of ASCII letters."""
    return F.regexp_count(text_or_empty(column), F.lit("[a-zA-Z]+"))


def state_line(column: Column | str, label: str) -> Column:
    """What follows `label:` at the start of a line."""
    return F.regexp_extract(text_or_empty(column), f"(?m)^{label}:[ \\t]*(.*)$", 1)


def verdict(column: Column | str, good: str, bad: str) -> Column:
    """True unless the reply says the bad word and not the good one first."""
    said = F.upper(F.trim(text_or_empty(column)))
    return F.when(said.startswith(bad), False).when(said.startswith(good), True).otherwise(~F.contains(said, F.lit(bad)) | F.contains(said, F.lit(good)))


def images_of(column: Column | str) -> Column:
    return F.regexp_extract_all(text_or_empty(column), F.lit(r"<img[^>]*src=\"([^\"]*)\""), 1)


def without_tags(column: Column | str) -> Column:
    """Text of HTML: scripts, styles and tags out, white space squeezed."""
    bare = F.regexp_replace(text_or_empty(column), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


#: Page families by words in the address, first match wins, then by what the page holds.
PAGE_FAMILIES = (
    ("form", "login|register|signup|form|checkout"),
    ("search", "search|query|q="),
    ("results", "result|list|browse|trending"),
    ("detail", "detail|product|item|article|wiki/"),
    ("ranking", "rank|top|chart|leaderboard|tiobe|index"),
)
SEARCH_INPUT = '<input[^>]*(type="search"|name="[^"]*search|placeholder="[^"]*(搜索|Search))'
LIST_ITEM = r'<(li|article)\b|<\w+[^>]*\bclass="([^"]*\s)?(card|item|result)[\s"]'
MODAL = r'role="dialog"|class="([^"]*\s)?(modal|popup|overlay)[\s"]'


def page_family(url: Column, html: Column) -> Column:
    """Ordered rules on the address; else a search input, more than twenty list items, a modal with fewer than five, or a detail page."""
    low, items = F.lower(url), F.regexp_count(html, F.lit(LIST_ITEM))
    by_address = F.coalesce(*[F.when(low.rlike(pattern), name) for name, pattern in PAGE_FAMILIES])
    by_content = F.when(html.rlike(SEARCH_INPUT), "search").when(items > 20, "results").when(html.rlike(MODAL) & (items < 5), "modal").otherwise("detail")
    return F.coalesce(by_address, by_content)


#: Shapes of goals and what they become, most special first, then single words.
GOAL_SHAPES = (
    (r"放大查看每个商品的图片进行视觉调研，找到与(「[^」]+」)最相关的商品并购买", r"查看各文档图片进行视觉调研，找到关于$1最相关的文档并引用相关证据"),
    (r"搜索商品并放大查看图片，确认哪个商品展示了(「[^」]+」)后购买", r"搜索并查看文档图片，确认哪个文档展示了$1后引用相关证据"),
    (r"搜索(「[^」]+」)相关商品，比较价格后购买最便宜的", r"搜索$1相关文档，分析内容后引用最相关的证据"),
    (r"查看各商品图片，找到展示了(「[^」]+」)的商品并购买", r"查看各文档图片，找到展示了$1的文档并引用相关证据"),
    (r"搜索商品，找到与(「[^」]+」)相关的产品并购买", r"搜索文档，找到关于$1的相关文档并引用证据"),
    (r"根据图片内容判断哪个商品展示了(「[^」]+」)，将其加入购物车", r"根据图片内容判断哪个文档展示了$1，引用相关证据"),
)
GOAL_WORDS = (
    ("比较价格后购买最便宜的", "分析内容后引用最相关的证据"), ("将其加入购物车", "引用相关证据"), ("并购买", "并引用相关证据"), ("后购买", "后引用相关证据"),
    ("购买", "引用"), ("产品", "文档"), ("商品", "文档"), ("找到与", "找到关于"),
)


def clean_goal(column: Column) -> Column:
    """The first shape that changes a goal decides; else its words are replaced one after another."""
    words = column
    for old, new in GOAL_WORDS:
        words = F.replace(words, F.lit(old), F.lit(new))
    changed = [F.regexp_replace(column, pattern, new) for pattern, new in GOAL_SHAPES]
    return F.coalesce(*[F.when(c != column, c) for c in changed], words)


#: Spans that carry a goal's meaning; signs of a goal that decides by price; the wrapping words of tasks.
QUOTED = ("「([^」]+)」", '"([^"]+)"', "'([^']+)'")
DECISIONS = ("最便宜", "cheapest", "compare.*price", "比较价格", "最低价", "lowest price")
WRAPPING_ZH = (
    "搜索商品[，,]?", "找到与?", "最?相关的商品并购买", "相关的产品并购买", "相关的产品", "并购买", "放大查看每个商品的图片进行视觉调研[，,]?", "放大查看[^，,。]*?[，,]", "浏览搜索结果[，,]?",
    "识别展示了?", "的商品并购买", "搜索并购买最便宜的", "比较价格后购买最便宜的", "查看各商品图片[，,]?", "找到展示了?", "进行视觉调研[，,]?", "视觉调研[，,]?",
)
WRAPPING_EN = ("search for and buy", "search and buy", "find and buy", "browse.*?and buy the", "look for", "purchase the", "buy the", "find the", "related to", "associated with")
EDGES = "，,。.\u3000 \\t\\n「」\"'"


def rewrite_query(column: Column) -> Column:
    """A retrieval query from a goal: a quoted span of more than three characters, else the goal itself if it decides
    by price, else the goal without wrapping words, unless fewer than four characters are left (X13)."""
    goal = F.trim(column)
    quoted = [F.trim(F.regexp_extract(goal, p, 1)) for p in QUOTED]
    bare = goal
    for pattern in WRAPPING_ZH:
        bare = F.regexp_replace(bare, pattern, "")
    for pattern in WRAPPING_EN:
        bare = F.regexp_replace(bare, f"(?i){pattern}", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, f"^[{EDGES}]+|[{EDGES}]+$", ""), r"\s+", " "))
    decides = goal.rlike("(?i)" + "|".join(DECISIONS))
    return F.coalesce(*[F.when(F.length(q) > 3, q) for q in quoted], F.when(decides, goal), F.when(F.length(bare) >= 4, bare), goal)


#: Question shapes, clauses for a constraint by its direction, hints by domain, and vague words for relations.
QUESTIONS = (
    "Identify the subject in the image. Through a series of connections — some involving {hint} — trace the chain of associations to its end. What is the final entity you reach? {constraint}",
    "Starting from the entity shown in the image, follow a multi-step trail of relationships. The path passes through domains related to {hint}, among others. Where does this investigation ultimately lead? {constraint}",
    "Look at the image. The subject is connected, through several degrees of separation, to a specific entity. The trail crosses into the domain of {hint} along the way. What entity do you arrive at? {constraint}",
    "The entity depicted in the image is the starting point of a research chain. Following its associations across multiple steps — including connections in the area of {hint} — what do you ultimately find? {constraint}",
    "Examine the image and identify the subject. A sequence of factual connections links it to a particular entity. At least one step involves {hint}. What is that entity? {constraint}",
)
CLAUSES = {
    "out": ("The answer is the one that {entity} {relation}.", "You are looking for the one that {entity} {relation}.", "Hint: {entity} {relation} the answer."),
    "in": ("The answer is the one that {relation} {entity}.", "You are looking for the one that {relation} {entity}.", "Hint: the answer {relation} {entity}."),
}
HINTS = {
    "PERSON": ("biographical details", "personal history", "someone's life and career", "individual backgrounds"),
    "WORK": ("creative works", "artistic productions", "media and entertainment", "cultural output"),
    "ORG": ("institutional connections", "organizational ties", "corporate and institutional networks"),
    "GEO": ("geographic associations", "places and territories", "spatial relationships"),
}
OTHER_HINT, OTHER_RELATION = "various associations", "is connected to"
VAGUE = {
    "educated at": "has an educational connection to",
    "member of sports team": "has a team affiliation with",
    "place of birth": "has origins connected to",
    "place of death": "has a historical connection to",
    "country": "is geographically tied to",
    "director": "has a creative connection to",
    "performer": "has a performance connection to",
    "record label": "has a label association with",
    "cast member": "features in the same production as",
    "founded by": "has a founding connection to",
    "headquarters location": "is based near",
    "located in the administrative territorial entity": "falls within the same administrative area as",
    "follows": "is the predecessor of",
    "followed by": "comes before",
    "twinned administrative body": "is paired with",
    "contains administrative territorial entity": "administratively encompasses",
    "part of": "belongs to the same collection as",
    "award received": "shares an honor with",
    "employer": "has a professional connection to",
    "owned by": "shares ownership ties with",
    "shares border with": "is geographically adjacent to",
    "participant of": "participated alongside",
    "member of political party": "shares political ties with",
    "capital": "serves as the seat of",
    "country of citizenship": "holds citizenship connections to",
    "notable work": "is known for work connected to",
    "sibling": "has a familial connection to",
    "has part": "structurally contains",
    "ethnic group": "has cultural ties to",
}


def _one_of(values: tuple[str, ...], draw: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (draw % len(values)).cast("int"))


def question_text(domain: Column, entity: Column, relation: Column, direction: Column, draws: tuple[Column, Column, Column]) -> Column:
    """A question that hides its path (X20): one of the shapes with a hint at a domain and a clause about the answer; three drawn
    numbers pick shape, hint and clause. A null entity leaves the clause out."""
    shape, hint_draw, clause_draw = draws
    hint = F.coalesce(*[F.when(domain == k, _one_of(v, hint_draw)) for k, v in HINTS.items()], F.lit(OTHER_HINT))
    vague = F.coalesce(*[F.when(relation == k, v) for k, v in VAGUE.items()], F.lit(OTHER_RELATION))
    clause = F.when(direction == "out", _one_of(CLAUSES["out"], clause_draw)).otherwise(_one_of(CLAUSES["in"], clause_draw))
    clause = F.coalesce(F.replace(F.replace(clause, F.lit("{entity}"), entity), F.lit("{relation}"), vague), F.lit(""))
    filled = F.replace(F.replace(_one_of(QUESTIONS, shape), F.lit("{hint}"), hint), F.lit("{constraint}"), clause)
    return F.trim(F.regexp_replace(filled, r"\s+", " "))


#: What a rewritten question begins with if it does not speak of an image, and words that give a type away.
IMAGE_LEAD = "Based on what is shown in the image: "
TYPE_WORDS = ("the person", "the building", "the film", "the movie", "the city", "the country", "the singer", "the actor", "the band", "the player", "the athlete")


def sane_rewrite(first: Column, second: Column, answer: Column) -> Column:
    """A rewritten question that does not give the answer away, the second try if the first does, null if both do."""
    bare = lambda c: F.btrim(F.btrim(F.trim(c), F.lit('"')), F.lit("'"))
    leaks = lambda c: F.contains(F.lower(c), F.lower(answer))
    one, two = bare(first), bare(second)
    said = F.when(~leaks(one), one).when(~leaks(two), two)
    said = F.when(F.contains(F.lower(said), F.lit("image")), said).otherwise(F.concat(F.lit(IMAGE_LEAD), said))
    pairs = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(w.title()).alias("t")) for w in TYPE_WORDS])
    neutral = lambda q, x: F.when(F.contains(F.lower(q), x["w"]), F.replace(F.replace(q, x["w"], F.lit("the subject")), x["t"], F.lit("The subject"))).otherwise(q)
    return F.aggregate(pairs, said, neutral)


def caption_parts(reply: Column, fallback: int = 200) -> Column:
    """(subject, description) from the last lines that are so labelled; without either, the reply's first characters describe."""
    lines = F.transform(F.split(reply, "\n"), lambda x: F.trim(x))
    labelled = lambda label: F.try_element_at(F.filter(lines, lambda x: F.upper(x).startswith(f"{label}:")), F.lit(-1))
    value = lambda label: F.coalesce(F.trim(F.regexp_replace(labelled(label), f"(?i)^{label}:\\s*", "")), F.lit(""))
    subject, description = value("SUBJECT"), value("DESCRIPTION")
    none = (subject == "") & (description == "")
    return F.struct(subject.alias("subject"), F.when(none, F.left(reply, F.lit(fallback))).otherwise(description).alias("description"))
