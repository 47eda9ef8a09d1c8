"""Rule tables: the default vocabulary and one for Latin-script tables."""

from __future__ import annotations

from dataclasses import dataclass, field

# The default vocabulary and points.
RISK_BASE = {"航行警告": 45, "海上气象": 40, "港口作业": 35, "航线运价": 25, "政策监管": 10, "招标采购": 5, "企业动态": 10}
OPPORTUNITY_BASE = {"招标采购": 55, "政策监管": 35, "航线运价": 20, "企业动态": 20, "港口作业": 10, "航行警告": 0, "海上气象": 0}
HIGH = {"停航": 35, "封港": 35, "禁止驶入": 35, "暂停作业": 32, "台风": 32, "红色预警": 32, "交通管制": 28, "能见度小于200米": 28}
MEDIUM = {"大风": 22, "大雾": 22, "延误": 20, "拥堵": 20, "限航": 20, "橙色预警": 20, "检修": 15, "费用上调": 12, "附加费": 12}
LOW = {"蓝色预警": 10, "黄色预警": 14, "调整": 8, "变更": 8, "临时": 6}
RELIEF = {"解除": -28, "恢复": -24, "取消预警": -28, "恢复正常": -30}
OPPORTUNITY = {"招标": 25, "采购": 22, "征集": 18, "中标": 12, "补贴": 22, "奖励": 20, "支持办法": 18, "新航线": 18, "升级改造": 15, "数字化": 12, "智能化": 12}
CONFIDENCE = {"政府/监管机构": 98, "港口/企业官网": 95, "交易所/行业机构": 90, "主流媒体": 75, "行业自媒体": 55, "其他": 40}
STATUS_PRIORITY = {"新增": 1.0, "持续": 1.0, "更新": 1.0, "解除": 0.0, "已结束": 0.0, "待核实": 0.65}
STATUS_CONFIDENCE = {"新增": 1.0, "持续": 1.0, "更新": 1.0, "解除": 1.0, "已结束": 1.0, "待核实": 0.65}
CATEGORY_TERMS = {
    "航行警告": ["航行警告", "航行通告", "航行风险", "通航风险", "禁航", "限航", "禁止驶入", "交通管制", "施工水域"],
    "海上气象": ["台风", "大风", "大雾", "能见度", "风暴潮", "海浪", "海冰", "气象预警"],
    "港口作业": ["码头", "泊位", "装卸", "闸口", "堆场", "检修", "作业暂停", "作业窗口", "港口作业"],
    "航线运价": ["运价", "附加费", "航线", "班轮", "舱位", "准班率", "费率"],
    "政策监管": ["政策", "办法", "规定", "监管", "海关", "通知", "实施意见", "补贴"],
    "招标采购": ["招标", "采购", "询价", "中标", "成交公告", "供应商", "项目公告"],
    "企业动态": ["企业", "公司", "签约", "合作", "投产", "开通"],
}
STATUS_TERMS = {
    "解除": ["解除", "恢复正常", "取消预警", "恢复通航"],
    "已结束": ["已结束", "截止", "终止", "完成"],
    "持续": ["持续", "继续", "仍将", "维持"],
    "更新": ["更新", "调整", "延期", "变更", "恢复"],
    "待核实": ["网传", "据称", "未经证实", "待核实"],
}
RESOLVED = ("解除", "已结束")


@dataclass(frozen=True)
class Rules:
    """What scoring and suggestions look up. Terms are matched as substrings, ignoring case."""

    risk_base: dict = field(default_factory=lambda: RISK_BASE)
    opportunity_base: dict = field(default_factory=lambda: OPPORTUNITY_BASE)
    high: dict = field(default_factory=lambda: HIGH)
    medium: dict = field(default_factory=lambda: MEDIUM)
    low: dict = field(default_factory=lambda: LOW)
    relief: dict = field(default_factory=lambda: RELIEF)
    opportunity: dict = field(default_factory=lambda: OPPORTUNITY)
    confidence: dict = field(default_factory=lambda: CONFIDENCE)
    status_priority: dict = field(default_factory=lambda: STATUS_PRIORITY)
    status_confidence: dict = field(default_factory=lambda: STATUS_CONFIDENCE)
    category_terms: dict = field(default_factory=lambda: CATEGORY_TERMS)
    status_terms: dict = field(default_factory=lambda: STATUS_TERMS)
    default_category: str = "企业动态"
    default_status: str = "新增"
    resolved: tuple = RESOLVED
    unverified: str = "待核实"
    high_from: int = 70
    medium_from: int = 40
    #: Terms that need more than a substring, as patterns.
    patterns: dict = field(default_factory=lambda: {"大风": "(?<!重)大风(?!险)"})


@dataclass(frozen=True)
class ValueLexicon:
    """Terms and categories that say how much an event matters to business. The defaults are fixed values."""

    activity: tuple = ("党建", "党支部", "主题党日", "青年联盟", "青年说", "文体活动", "荣获", "获奖", "荣誉", "慰问", "参观", "学习贯彻", "座谈交流")
    impact: tuple = ("航行警告", "风险预警", "大风", "大雾", "台风", "停航", "限航", "交通管制", "封航", "作业调整", "停靠", "延误", "拥堵", "费率", "运价", "航线调整", "采购公告", "招标公告", "开标", "投标")
    business: tuple = ("港口", "码头", "航运", "物流", "货代", "货主", "口岸", "通关", "船舶", "集装箱", "海铁联运", "多式联运", "供应链", "泊位", "锚地", "装卸", "运输", "采购", "招标", "监管", "申报")
    weather: tuple = ("大风", "大雾")
    safety: tuple = ("航行警告", "海上气象")
    trade: tuple = ("招标采购", "航线运价", "港口作业")
    policy: str = "政策监管"
    company: str = "企业动态"
    #: Terms of impact that need more than a substring, as patterns.
    patterns: dict = field(default_factory=lambda: {"大风": "(?<!重)大风(?!险)"})


LATIN_VALUES = ValueLexicon(activity=("cookie", "subscribe", "menu"), impact=("license", "idiot", "scum"), business=("ing", "ment", "keit", "que "), weather=("scum",), safety=("notice",), trade=("market",), policy="weather", company="company")


#: For tables of invented Latin-script prose.
LATIN = Rules(
    risk_base={"notice": 45, "weather": 40, "market": 25, "company": 10},
    opportunity_base={"market": 35, "company": 20, "notice": 0},
    high={"idiot": 35, "scum": 32, "trash": 28}, medium={"loser": 22, "moron": 20, "copyright": 15}, low={"the": 6, "license": 8},
    relief={"apache": -28, "mit license": -24}, opportunity={"http": 25, "@": 22, "ción": 12},
    confidence={"official": 98, "press": 75, "other": 40}, status_priority={"new": 1.0, "ongoing": 1.0, "resolved": 0.0, "unverified": 0.65}, status_confidence={"new": 1.0, "ongoing": 1.0, "resolved": 1.0, "unverified": 0.65},
    category_terms={"notice": ["copyright", "license", "rights"], "weather": ["heit", "ung", "keit"], "market": ["ción", "mente", "que"], "company": ["tion", "ing"]},
    status_terms={"resolved": ["apache", "mit license"], "ongoing": ["ently", "lly"], "unverified": ["cookie", "subscribe"]},
    default_category="company", default_status="new", resolved=("resolved",), unverified="unverified", patterns={},
)
