"""States, actions, styles and components of the small worlds that agents act in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The phases of the research world and what may be done in each; the actions of the shopping world.
PHASES = {"FORMULATE": ["search"], "SEARCH": ["open_result", "refine_query"], "BROWSE": ["cite_source", "back_to_results"]}
SHOP_ACTIONS = ("search", "click_product", "buy", "add_cart", "open_modal", "close_modal", "toggle_dropdown", "apply_filter", "back", "zoom")
SHOP_STATE = "page string, family string, selected int, searched boolean, cart array<int>, modal string, dropdown string, filters map<string,string>, stock map<int,int>, log array<struct<step:int,page:string,action:string,events:array<string>>>"
RESEARCH_STATE = "phase string, page string, opened int, queries int, cited array<int>, done boolean, total double, log array<struct<step:int,phase:string,option:string,page:string,citations:int,reward:double>>"


def episodes(acts: DataFrame, user: str, order: list[str], steps: int = 12) -> DataFrame:
    """(user, episode, acts): each user's actions in order, cut into episodes of at most `steps`; no array is longer than that."""
    n = F.row_number().over(Window.partitionBy(user).orderBy(*order)) - 1
    rest = [c for c in acts.columns if c not in (user, *order)]
    numbered = acts.select(user, F.floor(n / steps).alias("episode"), (n % steps).cast("int").alias("step"), *rest)
    return numbered.groupBy(user, "episode").agg(F.sort_array(F.collect_list(F.struct("step", *rest))).alias("acts"))


def shop_start(stock: dict[int, int]) -> Column:
    """The state in which a shopping episode begins: on the search page, nothing chosen, all products in stock."""
    none = F.lit(None)
    return F.struct(F.lit("search"), F.lit("search"), none, F.lit(False), F.array(), none, none, F.map_from_arrays(F.array(), F.array()), F.create_map(*[F.lit(x) for kv in stock.items() for x in kv]), F.array()).cast(f"struct<{SHOP_STATE}>")


def _put(entries: Column, key: Column, value: Column) -> Column:
    """A map with one entry set."""
    return F.map_concat(F.map_filter(entries, lambda k, _: k != key), F.create_map(key, value))


def shop_step(s: Column, a: Column) -> Column:
    """One of ten actions on a shopping state (U01). a: (step, action, product, name, key, value).

    A product can be opened once a search has shown it; only what is in stock is bought; back leads from a product to the
    results and from there to the search; an action without effect leaves no event.
    """
    did = lambda name: a["action"] == name
    shown = s["searched"] & F.coalesce(F.map_contains_key(s["stock"], F.coalesce(a["product"], F.lit(-1))), F.lit(False))
    left = F.coalesce(F.try_element_at(s["stock"], F.coalesce(s["selected"], F.lit(-1))), F.lit(0))
    click, buy, cart = did("click_product") & shown, did("buy") & (left > 0), did("add_cart") & s["selected"].isNotNull()
    closes = did("toggle_dropdown") & s["dropdown"].eqNullSafe(a["name"])
    from_detail, from_results = did("back") & (s["family"] == "detail"), did("back") & (s["family"] == "results")
    page = F.when(did("search") | from_detail, "results").when(click, F.concat(F.lit("detail_"), a["product"])).when(from_results, "search").otherwise(s["page"])
    family = F.when(did("search") | from_detail, "results").when(click, "detail").when(from_results, "search").otherwise(s["family"])
    cart_now = F.when(cart, F.array_append(s["cart"], s["selected"])).otherwise(s["cart"])
    moved = F.concat(F.lit("page_navigated:"), s["page"], F.lit(">"), page)
    events = F.array_compact(F.array(
        F.when(did("search") | click | did("back"), moved),
        F.when(buy, F.concat_ws(":", F.lit("inventory_changed"), s["selected"].cast("string"), left.cast("string"), (left - 1).cast("string"))),
        F.when(cart, F.concat(F.lit("cart_count_changed:"), F.size(cart_now))),
        F.when(buy, "toast_shown:success").when(cart, "toast_shown:info"),
        F.when(did("open_modal"), F.concat(F.lit("modal_opened:"), a["name"])).when(did("close_modal"), "modal_closed"),
        F.when(closes, F.concat(F.lit("dropdown_collapsed:"), a["name"])).when(did("toggle_dropdown"), F.concat(F.lit("dropdown_expanded:"), a["name"])),
        F.when(did("apply_filter"), F.concat(F.lit("filter_applied:"), a["key"], F.lit("="), a["value"])),
    ))
    return F.struct(
        page.alias("page"), family.alias("family"), F.when(click, a["product"]).when(~from_detail, s["selected"]).alias("selected"), (s["searched"] | did("search")).alias("searched"), cart_now.alias("cart"),
        F.when(did("open_modal"), a["name"]).when(~did("close_modal"), s["modal"]).alias("modal"), F.when(did("toggle_dropdown") & ~closes, a["name"]).when(~closes, s["dropdown"]).alias("dropdown"),
        F.when(did("apply_filter"), _put(s["filters"], a["key"], a["value"])).otherwise(s["filters"]).alias("filters"), F.when(buy, _put(s["stock"], s["selected"], left - 1)).otherwise(s["stock"]).alias("stock"),
        F.array_append(s["log"], F.struct(a["step"].alias("step"), s["page"].alias("page"), a["action"].alias("action"), events.alias("events"))).alias("log"),
    ).cast(f"struct<{SHOP_STATE}>")


def play_shop(episodes: DataFrame, stock: dict[int, int]) -> DataFrame:
    """Episodes with the state their actions lead to and a log of pages, actions and events (U01); acts is replaced by state."""
    return episodes.select(*[c for c in episodes.columns if c != "acts"], F.aggregate("acts", shop_start(stock), shop_step).alias("state"))


def research_options(phase: Column, results: Column, citations: Column, picture: Column, least: int = 1) -> Column:
    """What an agent may choose on a page (U13): every result can be opened, a report needs enough citations."""
    submit = F.when(citations >= least, F.array(F.lit("submit_report"))).otherwise(F.array().cast("array<string>"))
    opened = F.when(results > 0, F.transform(F.sequence(F.lit(1), F.greatest(results, F.lit(1))), lambda k: F.concat(F.lit("open_result_"), k))).otherwise(F.array().cast("array<string>"))
    zoom = F.when(picture, F.array(F.lit("zoom_doc_image"))).otherwise(F.array().cast("array<string>"))
    browse = F.concat(F.array(F.lit("back_to_results"), F.lit("cite_source")), zoom, submit)
    return F.when(phase == "FORMULATE", F.array(F.lit("search"))).when(phase == "SEARCH", F.concat(opened, F.array(F.lit("refine_query")), submit)).when(phase == "BROWSE", browse).otherwise(F.array().cast("array<string>"))


def research_start() -> Column:
    return F.struct(F.lit("FORMULATE"), F.lit("formulate"), F.lit(None), F.lit(0), F.array(), F.lit(False), F.lit(0.0), F.array()).cast(f"struct<{RESEARCH_STATE}>")


def research_step(s: Column, step: Column, option: Column, gold: Column, least: int = 1) -> Column:
    """One chosen option on a research state, with its reward (U10, U13). gold: the position of the wanted document among the
    results, null if it is not there. A null option, or one after the report, changes nothing."""
    on = option.isNotNull() & ~s["done"]
    did = lambda name: on & F.coalesce(option == name, F.lit(False))
    opens = on & F.coalesce(option.startswith("open_result_"), F.lit(False))
    result = F.when(opens, F.regexp_extract(option, r"(\d+)$", 1).try_cast("int"))
    looks = did("search") | did("refine_query")
    cites = did("cite_source") & s["opened"].isNotNull()
    cited = F.when(cites, F.array_append(s["cited"], s["opened"])).otherwise(s["cited"])
    found = F.coalesce(F.array_contains(s["cited"], gold), F.lit(False))
    reward = F.when(did("search"), 0.05 + F.when(gold.isNotNull(), 0.1).otherwise(0.0)).when(did("cite_source"), F.when(s["opened"].eqNullSafe(gold) & cites, 0.3).otherwise(0.05)).when(did("refine_query"), 0.03)
    reward = reward.when(opens, F.when(result.eqNullSafe(gold), 0.2).otherwise(0.0)).when(did("submit_report"), F.when(found, 2.0).otherwise(0.0) - F.when(F.size(s["cited"]) < least, 1.0).otherwise(0.0)).otherwise(0.0)
    reward = F.greatest(F.lit(-2.0), F.least(F.lit(3.0), reward - 0.02))
    phase = F.when(looks | did("back_to_results"), "SEARCH").when(opens, "BROWSE").when(did("submit_report"), "SYNTHESIZE").otherwise(s["phase"])
    page = F.when(looks | did("back_to_results"), "results").when(opens, F.concat(F.lit("document_"), result)).when(did("submit_report"), "report_submitted").otherwise(s["page"])
    entry = F.struct(step.alias("step"), s["phase"].alias("phase"), option.alias("option"), page.alias("page"), F.size(cited).alias("citations"), reward.alias("reward"))
    return F.struct(
        phase.alias("phase"), page.alias("page"), F.when(opens, result).when(~(looks | did("back_to_results")), s["opened"]).alias("opened"), (s["queries"] + looks.cast("int")).alias("queries"), cited.alias("cited"),
        (s["done"] | did("submit_report")).alias("done"), (s["total"] + F.when(on, reward).otherwise(0.0)).alias("total"), F.when(on, F.array_append(s["log"], entry)).otherwise(s["log"]).alias("log"),
    ).cast(f"struct<{RESEARCH_STATE}>")


def mismatches(phase: Column, page: Column, opened: Column, citations: Column, results: Column, submitted: Column, hashed: Column, event: Column, claim: Column) -> Column:
    """What a claimed change and the state it led to do not agree on (F23), by seven rules in their order. event: its type;
    claim: (results, document, citation, page, hash), null where the event does not say."""
    is_ = lambda name: F.coalesce(event == name, F.lit(False))
    pages = F.when(phase == "FORMULATE", page == "formulate").when(phase == "SEARCH", page == "results").when(phase == "SYNTHESIZE", page == "report_submitted").otherwise(True)
    rules = (
        ("result_count", is_("results_returned") & ~F.coalesce(claim["results"], F.lit(0)).eqNullSafe(results)),
        ("document_open", is_("document_opened") & ~claim["document"].eqNullSafe(opened)),
        ("citation_id", is_("evidence_collected") & F.coalesce(claim["citation"] > citations, F.lit(False)) & (claim["citation"] != 0)),
        ("page_nav", is_("page_navigated") & (F.coalesce(claim["page"], F.lit("")) != "") & (claim["page"] != page)),
        ("report_submitted", is_("report_submitted") & ~submitted),
        ("phase_page", ~pages | ((phase == "BROWSE") & ~page.startswith("document_"))),
        ("state_hash", (F.coalesce(claim["hash"], F.lit("")) != "") & (claim["hash"] != hashed)),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules]))


def available_actions(phase: Column, citations: Column, least: Column) -> Column:
    """What may be done in a phase; a report may be handed in once there are enough citations."""
    own = F.coalesce(*[F.when(phase == p, F.array(*map(F.lit, a))) for p, a in PHASES.items()], F.array().cast("array<string>"))
    report = (~phase.isin(*PHASES)) | (phase.isin("SEARCH", "BROWSE") & (citations >= least))
    return F.when(report, F.array_append(own, "submit_report")).otherwise(own)


def coverage(facts: Column, cited: Column) -> Column:
    """Covered facts by facts, 1 where there are none."""
    return F.when(F.size(facts) == 0, 1.0).otherwise(F.size(F.array_intersect(facts, cited)) / F.size(facts))


def context_budget(messages: DataFrame, budget: int) -> DataFrame:
    """(conv_id, turn) that stay: two head messages, a last one without a partner, and the newest pairs that fit into budget
    quarters of characters (W09)."""
    one = Window.partitionBy("conv_id")
    m = messages.select("conv_id", "turn", F.length("text").alias("n"), (F.row_number().over(one.orderBy("turn")) - 1).alias("i"), F.count("*").over(one).alias("c"))
    always = (F.col("i") < 2) | ((F.col("i") == F.col("c") - 1) & ((F.col("c") - 2) % 2 == 1))
    m = m.withColumns({"pair": F.when(F.col("i") < 2, -1).otherwise(F.floor((F.col("i") - 2) / 2)), "always": always})
    newest = one.orderBy(F.desc("pair")).rangeBetween(Window.unboundedPreceding, 0)
    m = m.withColumns({"fixed": F.sum(F.when(F.col("always"), F.col("n"))).over(one), "later": F.coalesce(F.sum(F.when(~F.col("always"), F.col("n"))).over(newest), F.lit(0))})
    return m.where(F.col("always") | (F.floor((F.col("fixed") + F.col("later")) / 4) <= budget)).select("conv_id", "turn")


def channel(color: Column, k: int) -> Column:
    """A channel of #rrggbb, 0 to 255."""
    return F.conv(F.substring(color, 2 + 2 * k, 2), 16, 10).cast("double")


def luminance(color: Column) -> Column:
    """Relative luminance by WCAG."""
    linear = lambda c: F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    r, g, b = (linear(channel(color, k) / 255) for k in range(3))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


_part = "(CASE WHEN ('0x' || substring({{c}}, {0}, 2))::UBIGINT / 255.0::DOUBLE <= 0.03928 THEN ('0x' || substring({{c}}, {0}, 2))::UBIGINT / 255.0::DOUBLE / 12.92 ELSE pow((('0x' || substring({{c}}, {0}, 2))::UBIGINT / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"
LUMINANCE_SQL = f"(0.2126::DOUBLE * {_part.format(1)} + 0.7152::DOUBLE * {_part.format(3)} + 0.0722::DOUBLE * {_part.format(5)})"


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def readability(text_contrast: Column, nav_contrast: Column, font: Column, radius: Column, shadow: Column) -> Column:
    """Points for contrast, font, corners and shadow, at most 1."""
    points = F.when(text_contrast >= 7, 0.4).when(text_contrast >= 4.5, 0.3).when(text_contrast >= 3, 0.1).otherwise(0.0)
    points += F.when(nav_contrast >= 4.5, 0.2).when(nav_contrast >= 3, 0.1).otherwise(0.0)
    points += F.when(F.length(font) > 0, 0.2).otherwise(0.0) + F.when(radius.between(6, 24), 0.1).otherwise(0.0) + F.when(shadow.between(0.02, 0.15), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), points)


def appeal(distance: Column, navbar: Column, footer: Column, spacing: Column, density: Column) -> Column:
    """Points for distance of colours, layout, spacing and density."""
    points = F.when((distance > 50) & (distance < 200), 0.3).when(distance >= 200, 0.2).otherwise(0.0)
    points += F.when(navbar, 0.15).otherwise(0.0) + F.when(footer, 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), points + F.when(spacing.between(0.9, 1.2), 0.2).otherwise(0.0) + F.when(density.isin("normal", "comfortable"), 0.2).otherwise(0.0))


def overall(readable: Column, appealing: Column) -> Column:
    return readable * 0.6 + appealing * 0.4


def blend(a: Column, b: Column, share: float) -> Column:
    """A colour between two, `share` of the first."""
    mixed = [F.floor(share * channel(a, k) + (1 - share) * channel(b, k)).cast("int") for k in range(3)]
    return F.format_string("#%02x%02x%02x", *mixed)


def blend_styles(x: Column, y: Column, share: float, strategy: Column) -> Column:
    """Two styles (primary, density, radius, navbar) in one (V23): all mixed, the first's colours on the second's layout, or the reverse."""
    by = lambda mixed, colors, layout: F.when(strategy == "balanced", mixed).when(strategy == "color_from_1", colors).otherwise(layout)
    return F.struct(
        by(blend(x["primary"], y["primary"], share), x["primary"], y["primary"]).alias("primary"), by((x if share > 0.5 else y)["density"], y["density"], x["density"]).alias("density"),
        by(x["radius"] * share + y["radius"] * (1 - share), y["radius"], x["radius"]).alias("radius"), by(x["navbar"] | y["navbar"], y["navbar"], x["navbar"]).alias("navbar"),
    )


def component_score(w: Column, h: Column, text: Column, children: Column, html: Column, classes: Column) -> Column:
    """Points for size, text, children, markup and classes, at most 1."""
    points = F.when((w > 100) & (w < 1300) & (h > 30) & (h < 800), 0.3).when((w > 50) & (h > 20), 0.1).otherwise(0.0)
    points += F.when(text > 5, 0.2).otherwise(0.0) + F.when(children.between(2, 20), 0.2).when(children > 0, 0.1).otherwise(0.0)
    points += F.when((html > 200) & (html < 5000), 0.2).when(html > 50, 0.1).otherwise(0.0) + F.when(classes > 0, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), points)
