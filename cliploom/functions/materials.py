"""Material names: process words, product forms, categories, search texts.

The word lists are parameters with the values of the surveyed system as defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ------------------------------------------------------------------
FORMS = ("干", "片", "粉", "条", "丝", "块", "粒", "叶")
PROCESS_WORDS = (
    "热泵烘干", "烘干机", "烘干房", "烘干设备", "干燥机", "生产线", "烘干", "干燥", "加工",
    "生产", "制作", "设备", "流程", "工艺", "技术", "车间", "厂家", "价格",
)
CATEGORY_WORDS = {
    "fruit": ("苹果", "香蕉", "梨", "桃", "杏", "枣", "葡萄", "芒果", "菠萝", "柠檬", "猕猴桃", "山楂", "无花果"),
    "vegetable": ("辣椒", "番茄", "茄子", "豆角", "香菇", "木耳", "萝卜", "白菜", "南瓜", "洋葱"),
    "root": ("山药", "红薯", "土豆", "芋头", "葛根", "姜", "蒜", "百合"),
    "herb": ("药材", "枸杞", "黄芪", "人参", "当归", "陈皮", "菊花", "金银花", "甘草", "灵芝"),
    "seafood": ("鱼", "虾", "海参", "鲍鱼", "鱿鱼", "海带", "紫菜", "贝"),
    "grain": ("玉米", "稻谷", "小麦", "花生", "豆"),
}
PROCESS_FORM = {"fruit": "片", "vegetable": "片", "root": "片", "herb": "", "seafood": "", "grain": ""}
UNDRIED = ("herb", "seafood", "grain")
# ---- end of fixed values -----------------------------------------------------------


def stripped(name: Column, words=PROCESS_WORDS) -> Column:
    """Trailing process words off again and again, as long as something stays."""
    return F.regexp_replace(F.trim(name), f"^(.+?)(?:{'|'.join(words)})+$", "$1")


def base(name: Column, forms=FORMS) -> Column:
    """One product form off, if two characters stay."""
    return F.regexp_replace(name, f"^(.{{2,}})(?:{'|'.join(forms)})$", "$1")


def material_base(name: Column) -> Column:
    return base(stripped(name))


def category(name: Column, words=CATEGORY_WORDS) -> Column:
    """The first category of which the name holds a word."""
    found = None
    for key, own in words.items():
        hit = name.rlike("|".join(own))
        found = F.when(hit, key) if found is None else found.when(hit, key)
    return found.otherwise("unknown")


def form(name: Column, forms=FORMS) -> Column:
    """The product form of a name, else the dried one where the category is usually dried."""
    own = F.regexp_extract(name, f"^.{{2,}}({'|'.join(forms)})$", 1)
    return F.when(own != "", own).when(category(name).isin(*UNDRIED), "").otherwise("干")


def canonical(value: Column, reference: Column) -> Column:
    """The reference's base name where the value names the same material, else the value's own base."""
    text, ours = F.trim(F.coalesce(value, F.lit(""))), material_base(F.coalesce(reference, F.lit("")))
    own = material_base(text)
    same = (ours != "") & (own != "") & (own.endswith(ours) | ours.endswith(own))
    return F.when(text == "", ours).when(same, ours).otherwise(F.coalesce(F.nullif(own, F.lit("")), text))


def implied_state(name: Column, forms=FORMS) -> Column:
    return F.when(F.regexp_extract(F.trim(name), f"^.{{2,}}({'|'.join(forms)})$", 1) == "干", "dried").otherwise("unknown")


def expanded(name: Column, most: int = 10, extra: tuple[str, ...] = ()) -> Column:
    """Up to ``most`` distinct search texts of a material in fixed order; ``extra`` holds ``{base}``, ``{form}``, ``{material}``."""
    text = F.trim(name)
    own, made = base(text), form(text)
    cut = F.coalesce(F.create_map(*[F.lit(x) for pair in PROCESS_FORM.items() for x in pair])[category(text)], F.lit("片"))
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    texts = [
        text, join(own, "烘干"), F.when(cut != "", join(own, cut, "烘干")), join(own, "热泵烘干"), join(own, "烘干机"), join(own, "烘干房"),
        join(own, made, "制作"), join(own, made, "加工"), join(own, made, "生产"), join(own, cut, "干燥"),
    ]
    for template in extra:
        filled = F.lit(template)
        for key, value in (("{base}", own), ("{form}", made), ("{material}", text)):
            filled = F.replace(filled, F.lit(key), value)
        texts.append(filled)
    return F.slice(F.array_distinct(F.filter(F.array(*texts), lambda x: x.isNotNull())), 1, most)
