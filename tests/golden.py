"""A consistent weekly bundle as Python rows, and bundles that each break one thing."""

import copy

from weekloom import fixed

NAMES = ["ALPHA", "BETA", "GAMMA"]
CONVERSION = {"spend": [1000, 800, 600], "value": [3000, 2000, 1000], "buys": [20, 10, 5],
              "adds": [70, 40, 30], "shown": [50000, 30000, 20000], "clicks": [500, 300, 200]}
TRAFFIC = {"spend": [100, 200, 300], "shown": [20000, 15000, 15000], "clicks": [100, 150, 250]}
DATES = {fixed.START_HEADER: "2025-01-06", fixed.END_HEADER: "2025-01-12"}
AVERAGE = fixed.AVERAGE_VALUE_HEADERS[0]


def bundle():
    """{kind: [row dict, ...]} with headers as keys."""
    overall = {"Starts": "2025-01-06", "Ends": "2025-01-12", fixed.SPENT: "$3,000.00",
               fixed.VALUE: "6000", fixed.ROAS: "2", "Purchases": "35", "Adds to cart": "140",
               "Cost per purchase": "85.71", "Cost per add to cart": "21.43",
               "Link clicks": "1,500", fixed.CTR: "1.0%", **DATES}
    days = [{"Day": f"2025-01-{12 - i:02d}", "Adds to cart": "20", "Purchases": "5",
             fixed.ROAS: "2", fixed.SPENT: "600" if i == 6 else "400",
             fixed.VALUE: "600" if i == 6 else "900", **DATES} for i in range(7)]
    products, campaigns, creatives, traffic, audience = [], [], [], [], []
    for i, name in enumerate(NAMES):
        spend, value = CONVERSION["spend"][i], CONVERSION["value"][i]
        buys, adds = CONVERSION["buys"][i], CONVERSION["adds"][i]
        counts = {"Purchases": str(buys), "Adds to cart": str(adds)}
        products.append({"Campaign name": f"C | PRODUCT {name}", "Name": f"product  {name}",
                         **counts, fixed.ROAS: "2", fixed.VALUE: str(value),
                         "Average purchases conversion value": str(value / buys),
                         fixed.SPENT: str(spend + TRAFFIC["spend"][i]), **DATES})
        prices = {fixed.CTR: "1", fixed.CPM: "20", fixed.CPC: "2"}
        costs = {"Cost per purchase": str(spend / buys), "Cost per add to cart": str(spend / adds)}
        campaigns.append({"Campaign name": f"C | PRODUCT {name} | CONVERSION",
                          fixed.SPENT: str(spend), fixed.VALUE: str(value), fixed.ROAS: "3",
                          **counts, **costs, "Purchases rate per landing page views": "0.05",
                          "Add to cart Rate": "0.25", "Impressions": str(CONVERSION["shown"][i]),
                          "Link clicks": str(CONVERSION["clicks"][i]), **prices, AVERAGE: "150",
                          **DATES})
        for n in range(2):
            creatives.append({"Ads": f" Creative-{i}-{n} ",
                              "Campaign name": f"C | PRODUCT {name} | CONVERSION",
                              fixed.SPENT: str(spend / 4), **prices, **costs, fixed.ROAS: "3",
                              AVERAGE: "150", **counts, **DATES})
        audience.append({"Ad Set Name": f"A | PRODUCT {name}", **counts, fixed.ROAS: "3",
                         fixed.VALUE: str(value), fixed.SPENT: str(spend), **DATES})
        traffic.insert(0, {"Campaign name": f"T | PRODUCT {name}",
                           fixed.SPENT: str(TRAFFIC["spend"][i]), "Purchases": "",
                           "Adds to cart": "3", "Impressions": str(TRAFFIC["shown"][i]),
                           "Link clicks": str(TRAFFIC["clicks"][i]), **prices,
                           "Landing page views": "60", "Cost per landing page view": "2",
                           "Landing page views rate per link clicks": "60", **DATES})
    keywords = [{"Keyword": f'""word {i}""', "Conversions": str(i % 5 + 1),
                 "Conv. value / cost": "4", "Cost": "10", "Conv. value": "40"} for i in range(12)]
    return {"overall": [overall], "by_day": days, "by_product": products, "campaign": campaigns,
            "creative": creatives, "traffic_campaign": traffic, "audience": audience,
            "keyword": keywords}


def changed(kind, row, header, text):
    def apply(b):
        b[kind][row][header] = text
    return apply


def without(kind, row=None):
    def apply(b):
        if row is None:
            del b[kind]
        else:
            del b[kind][row]
    return apply


def repeated(kind):
    def apply(b):
        b[kind].append(dict(b[kind][0]))
    return apply


def shifted(kind):
    def apply(b):
        for row in b[kind]:
            row[fixed.END_HEADER] = "2025-01-11"
    return apply


MUTATIONS = {  # expected issue code: change of the good bundle
    "DAILY_SPEND_RECONCILIATION": changed("by_day", 0, fixed.SPENT, "401"),
    "DAILY_VALUE_RECONCILIATION": changed("by_day", 0, fixed.VALUE, "901"),
    "DAILY_PURCHASE_RECONCILIATION": changed("by_day", 1, "Purchases", "6"),
    "DAILY_ATC_RECONCILIATION": changed("by_day", 1, "Adds to cart", "21"),
    "DAILY_DATE_COVERAGE": changed("by_day", 0, "Day", "2025-01-11"),
    "PRODUCT_SPEND_RECONCILIATION": changed("by_product", 0, fixed.SPENT, "1101"),
    "PRODUCT_SPEND_COMPONENTS": changed("by_product", 1, fixed.SPENT, "999"),
    "PRODUCT_VALUE_RECONCILIATION": changed("by_product", 0, fixed.VALUE, "3001"),
    "SUMMARY_CAMPAIGN_VALUE": changed("by_product", 1, fixed.VALUE, "2001"),
    "PRODUCT_PURCHASE_RECONCILIATION": changed("by_product", 0, "Purchases", "21"),
    "PRODUCT_ATC_RECONCILIATION": changed("by_product", 0, "Adds to cart", "71"),
    "SUMMARY_CAMPAIGN_COUNTS": changed("by_product", 1, "Purchases", "11"),
    "AUDIENCE_CAMPAIGN_SPEND": changed("audience", 0, fixed.SPENT, "1001"),
    "AUDIENCE_CAMPAIGN_VALUE": changed("audience", 0, fixed.VALUE, "3001"),
    "AUDIENCE_CAMPAIGN_COUNTS": changed("audience", 0, "Purchases", "19"),
    "TRAFFIC_PRODUCT_SET": without("traffic_campaign", 0),
    "AUDIENCE_PRODUCT_SET": without("audience", 0),
    "MISSING_PRODUCT": without("by_product", 0),
    "PRODUCT_SUMMARY_SET": without("by_product", 1),
    "DUPLICATE_PRODUCT": repeated("traffic_campaign"),
    "UNMATCHED_PRODUCT": changed("audience", 1, "Ad Set Name", "A | unknown"),
    "CTR_RECONCILIATION": changed("overall", 0, fixed.CTR, "1.02"),
    "CLICK_RECONCILIATION": changed("overall", 0, "Link clicks", "1501"),
    "CAMPAIGN_TRAFFIC_SPEND_RECONCILIATION": changed("campaign", 0, fixed.SPENT, "1001"),
    "INVALID_LINK_CLICKS": changed("overall", 0, "Link clicks", "0"),
    "INVALID_CREATIVE_METRIC": changed("creative", 0, fixed.CPM, "-1"),
    "CREATIVE_PIN_COUNT": changed("creative", 0, "Ads", "other"),
    "CREATIVE_PIN_PRODUCT": changed("creative", 0, "Campaign name", "PRODUCT BETA"),
    "TOO_FEW_KEYWORDS": lambda b: b.update(keyword=b["keyword"][:7]),
    "KEYWORD_COUNT": lambda b: b.update(keyword=b["keyword"][:6]),
    "UNREADABLE_VALUE": changed("keyword", 11, "Conversions", "many"),
    "MISSING_SOURCE": without("audience"),
    "SOURCE_SET_MISMATCH": without("keyword"),
    "SOURCE_PERIOD_MISMATCH": shifted("creative"),
    "OVERALL_ROW_COUNT": repeated("overall"),
    "OVERALL_PERIOD_MISMATCH": shifted("overall"),
}


def all_bundles():
    """{bundle id: (market, {kind: rows})}: the good one, one per mutation, other markets."""
    made = {"good": ("MARKET A", bundle())}
    for code, change in MUTATIONS.items():
        broken = copy.deepcopy(bundle())
        change(broken)
        made[code] = ("MARKET A", broken)
    made["MISSING_PREVIOUS_OVERALL"] = ("MARKET B", bundle())
    made["HISTORY_NOT_ADJACENT"] = ("MARKET C", bundle())
    return made
