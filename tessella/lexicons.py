"""Word lists, patterns and weights as data.  Operators take a Lexicon; two are shipped: `ZH_FINANCE` for Chinese
financial news and `LATIN_DEMO`, whose words occur in Latin-script text."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------------------------------------------------
# Term replacements, word lists, patterns and weights that results depend on.
# ---------------------------------------------------------------------------------------------------------------------
TERM_REPLACEMENTS = [
    ("涨停板", "涨停"), ("跌停板", "跌停"), ("股票价格", "股价"), ("市场价值", "市值"),
    ("净资产收益率", "ROE"), ("每股收益", "EPS"), ("市盈率", "PE"), ("市净率", "PB"),
]
KEYWORD_STOPWORDS = "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这".split()
QUERY_STOPWORDS = "的 了 在 是 我 有 和 就 不 人 都 一 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那".split()
CATEGORY_WORDS = {
    "股票相关": "股票 股价 涨停 跌停 成交量 市值 股东 分红 配股".split(),
    "财务指标": "营收 利润 ROE EPS PE PB 资产 负债 现金流".split(),
    "市场动态": "IPO 重组 并购 增发 回购 停牌 复牌 退市".split(),
    "监管政策": "证监会 交易所 监管 政策 法规 公告 处罚 审核".split(),
    "行业分析": "行业 板块 概念 龙头 景气度 周期 趋势 竞争".split(),
}
CATEGORY_DEFAULT = "通用财经"
POSITIVE_SHORT = "上涨 增长 盈利 利好 看好 推荐 买入 强势 突破".split()
NEGATIVE_SHORT = "下跌 亏损 利空 看空 卖出 弱势 跌破 风险 警告".split()
ENTITY_PATTERNS = {
    "stock_code": "[0-9]{6}|[A-Z]{2,4}",
    "money": "[0-9,]+\\.?[0-9]*\\s*[万亿千百]*元",
    "percentage": "[0-9]+\\.?[0-9]*%",
    "date": "[0-9]{4}[-年][0-9]{1,2}[-月][0-9]{1,2}[日]?",
    "company": "[A-Za-z一-龥]+(?:股份)?(?:有限)?公司|[A-Za-z一-龥]+集团",
}
SPAM_PATTERNS = ["点击.*查看", "更多.*详情", "联系.*客服", "广告.*推广", "免费.*咨询"]
CONTACT_PATTERN = "(?:电话|手机|微信|QQ)[:：]\\s*\\d+"
VALUE_PHRASES = "分析报告 研究报告 财务分析 市场分析 行业研究 投资建议 风险评估 业绩预告 公司公告 监管公告".split()
QUALITY_WEIGHTS = {"completeness": 0.25, "content_quality": 0.25, "information_value": 0.25, "spam_detection": 0.15, "structure_quality": 0.10}

POSITIVE_WORDS = """
好 棒 优秀 出色 卓越 杰出 优异 良好 不错 满意 成功 胜利 获胜 赢得 取得 实现 达成 完成 突破 创新
增长 上涨 提升 改善 优化 加强 扩大 增加 提高 发展 盈利 获利 赚钱 收益 回报 分红 派息 配股 送股
涨停 大涨 暴涨 飙升 攀升 走高 上扬 反弹 回升 买入 增持 推荐 看好 看涨 做多 利好 积极 乐观
强势 强劲 稳健 稳定 健康 良性 向好 复苏 创新高 新高 历史新高 超预期 超额 领先 领涨
扭亏 扭亏为盈 减亏 盈转 营收增长 利润增长 业绩增长 净利润增长 毛利率提升
""".split()
NEGATIVE_WORDS = """
差 糟 坏 恶劣 糟糕 失败 错误 问题 困难 麻烦 下降 下跌 减少 降低 恶化 衰退 萎缩 缩减 削减
损失 亏损 赔钱 破产 倒闭 关闭 停产 裁员 减薪 巨亏 预亏 首亏 扩亏 亏转 由盈转亏
跌停 大跌 暴跌 重挫 下挫 走低 下滑 回落 跳水 卖出 减持 抛售 看空 看跌 做空 利空 悲观 担忧
疲软 疲弱 低迷 萎靡 不振 下行 危机 破位 跌破 创新低 新低 历史新低 不及预期 低于预期
风险 危险 警告 预警 违约 违规 处罚 罚款 调查 暂停 停牌 退市 摘牌 ST *ST 特别处理
""".split()
INTENSITY = {
    "极其": 2.0, "非常": 1.8, "特别": 1.6, "十分": 1.5, "很": 1.3, "比较": 1.1, "相对": 0.9, "稍微": 0.7, "略微": 0.6, "有点": 0.5, "一点": 0.4,
    "大幅": 1.8, "显著": 1.6, "明显": 1.4, "小幅": 0.8, "微幅": 0.6, "急剧": 2.0, "快速": 1.5, "迅速": 1.5, "缓慢": 0.7, "逐步": 0.8,
}
NEGATIONS = "不 没 无 非 未 否 别 莫 勿 毋".split()
FINANCE_SHIFTS = [
    ("超预期|好于预期|业绩增长|盈利增长|营收增长", 0.2), ("涨停|大涨|暴涨|飙升|创新高", 0.3), ("买入|增持|推荐|看好|利好", 0.2), ("分红|派息|送股|配股", 0.1),
    ("不及预期|低于预期|业绩下滑|亏损|巨亏", -0.2), ("跌停|大跌|暴跌|重挫|创新低", -0.3), ("卖出|减持|看空|利空|风险", -0.2), ("ST|退市|停牌|违约|处罚", -0.3),
]
NEWS_TYPES = {
    "公司公告": ("公告 披露 股东大会 董事会 监事会 年报 季报 半年报 重大事项 关联交易 股权变动 高管变动 业绩预告 业绩快报".split(), [".*公司.*公告", ".*披露.*", ".*股东大会.*决议"]),
    "市场新闻": ("市场 交易 成交 涨跌 指数 板块 概念股 龙头股 资金流向 北向资金 南向资金 融资融券 大宗交易".split(), [".*指数.*", ".*板块.*", ".*概念.*"]),
    "政策法规": ("政策 法规 监管 央行 证监会 银保监会 发改委 财政部 国务院 通知 意见 办法 规定 条例".split(), [".*监管.*", ".*政策.*", ".*法规.*"]),
    "行业动态": ("行业 产业 供应链 上下游 竞争 市场份额 技术 创新 研发 专利 合作 并购 重组".split(), [".*行业.*", ".*产业.*"]),
    "宏观经济": ("GDP CPI PPI PMI M1 M2 通胀 通缩 利率 汇率 贸易 进出口 外汇储备 财政 货币政策".split(), [".*经济.*", ".*宏观.*"]),
    "国际财经": ("美联储 欧央行 日央行 美股 欧股 港股 原油 黄金 美元 欧元 日元 国际 全球 海外 外盘".split(), [".*国际.*", ".*全球.*", ".*海外.*"]),
}
INDUSTRIES = {
    "银行": "银行 工商银行 建设银行 农业银行 中国银行 交通银行 招商银行".split(),
    "证券": "证券 券商 中信证券 华泰证券 国泰君安 海通证券 广发证券".split(),
    "保险": "保险 中国平安 中国人寿 新华保险 中国太保 中国人保".split(),
    "房地产": "房地产 地产 万科 恒大 碧桂园 保利 融创 中海".split(),
    "科技": "科技 互联网 人工智能 AI 大数据 云计算 5G 芯片 半导体".split(),
    "医药": "医药 生物 制药 疫苗 医疗 医院 药品 医疗器械".split(),
    "汽车": "汽车 新能源车 电动车 比亚迪 特斯拉 蔚来 小鹏 理想".split(),
    "能源": "能源 石油 天然气 煤炭 电力 新能源 风电 光伏 核电".split(),
    "消费": "消费 零售 食品 饮料 白酒 茅台 五粮液 家电 服装".split(),
    "制造业": "制造 工业 机械 钢铁 有色 化工 建材 轻工".split(),
}
IMPORTANCE = {
    "high": ("重大 重要 紧急 突发 首次 历史 创新高 创新低 涨停 跌停 停牌 复牌 退市 IPO 并购 重组".split(), [".*重大.*", ".*重要.*", ".*突发.*"]),
    "medium": ("公告 披露 变动 调整 增长 下降 合作 签约".split(), [".*公告.*", ".*变动.*"]),
    "low": ("日常 例行 常规 维持 持续 延续".split(), [".*日常.*", ".*例行.*"]),
}
RELEVANCE = {
    "high": ("投资 买入 卖出 推荐 评级 目标价 估值 分红 业绩 财报 利润 营收 增长 亏损".split(), [".*投资.*", ".*评级.*", ".*业绩.*"]),
    "medium": ("市场 行业 竞争 发展 前景 趋势 政策 监管".split(), [".*市场.*", ".*行业.*"]),
    "low": ("会议 活动 人事 管理 文化 社会责任".split(), [".*会议.*", ".*活动.*"]),
}
ENTITY_OFFSET_PATTERNS = {
    "stock_code": ["\\b[0-9]{6}\\b", "\\b[A-Z]{1,5}\\b", "(?i)\\b[0-9]{4}\\.HK\\b"],
    "money": ["[0-9,]+\\.?[0-9]*\\s*[万亿千百]*元", "[0-9,]+\\.?[0-9]*\\s*万", "[0-9,]+\\.?[0-9]*\\s*亿", "\\$[0-9,]+\\.?[0-9]*[MBK]?", "[0-9,]+\\.?[0-9]*\\s*美元"],
    "percentage": ["[0-9]+\\.?[0-9]*%", "百分之[0-9]+\\.?[0-9]*"],
    "date": ["[0-9]{4}[-年][0-9]{1,2}[-月][0-9]{1,2}[日]?", "[0-9]{1,2}月[0-9]{1,2}[日号]", "[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"],
    "time": ["[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?", "[上下午]*[0-9]{1,2}点[0-9]{0,2}[分]?"],
    "company": ["[A-Za-z一-龥]+(?:股份)?(?:有限)?公司", "[A-Za-z一-龥]+集团(?:股份)?(?:有限公司)?", "[A-Za-z一-龥]+(?:银行|证券|保险|基金|信托)", "[A-Z][a-z]+\\s+(?:Inc\\.|Corp\\.|Ltd\\.|Co\\.)"],
    "financial_product": ["[A-Za-z一-龥]+基金", "[A-Za-z一-龥]+债券", "[A-Za-z一-龥]+期货", "[A-Za-z一-龥]+ETF"],
    "person": ["[A-Za-z一-龥]{2,4}(?:先生|女士|总裁|董事长|CEO|CFO|CTO)", "(?:董事长|总经理|CEO|CFO|CTO)[A-Za-z一-龥]{2,4}"],
    "location": [
        "[A-Za-z一-龥]+(?:省|市|区|县|镇|村)",
        "(?:北京|上海|广州|深圳|杭州|南京|成都|重庆|天津|武汉|西安|青岛|大连|厦门|苏州|无锡|宁波|佛山|东莞|中山|珠海|惠州|江门|汕头|湛江|肇庆|梅州|茂名|阳江|韶关|河源|清远|潮州|揭阳|云浮)",
    ],
}
ENTITY_TERMS = {
    "company": "中国平安 招商银行 工商银行 建设银行 农业银行 中国银行 中信证券 华泰证券 国泰君安 海通证券 广发证券 申万宏源 腾讯控股 阿里巴巴 百度 京东 美团 拼多多 字节跳动 中国移动 中国联通 中国电信 中国石油 中国石化 中国海油 贵州茅台 五粮液 泸州老窖 剑南春 水井坊 舍得酒业 比亚迪 宁德时代 特斯拉 蔚来 小鹏汽车 理想汽车".split(),
    "financial_institution": "证监会 银保监会 央行 人民银行 上交所 深交所 北交所 中金公司 中信建投 东方财富 同花顺 大智慧 通达信 天弘基金 易方达 华夏基金 嘉实基金 南方基金 博时基金".split(),
    "financial_product": "沪深300 上证50 中证500 创业板指 科创50 国债ETF 黄金ETF 原油ETF 纳指ETF 标普500ETF 货币基金 债券基金 股票基金 混合基金 指数基金".split(),
    "economic_indicator": "GDP CPI PPI PMI M1 M2 M0 社会融资规模 新增贷款 外汇储备 贸易顺差 贸易逆差 失业率 通胀率 基准利率 存款准备金率".split(),
}
#: Labels of external taggers to entity types.
TAGGER_LABELS = {"PER": "person", "PERSON": "person", "LOC": "location", "GPE": "location", "ORG": "company", "TIME": "time", "DATE": "date", "MONEY": "money", "PERCENT": "percentage", "PRODUCT": "financial_product"}
SYNONYM_GROUPS = [
    "股票,证券,equity", "债券,bond", "基金,fund", "期货,futures", "外汇,forex,fx", "A股,沪深股市", "港股,恒生指数", "美股,纳斯达克,道琼斯",
    "涨停,涨停板,daily_limit_up", "跌停,跌停板,daily_limit_down", "买入,做多,long", "卖出,做空,short", "市盈率,PE,P/E", "市净率,PB,P/B",
    "净资产收益率,ROE", "每股收益,EPS", "毛利率,gross_margin", "净利率,net_margin",
]
INDEX_STOPWORDS = "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 股票 公司 市场 投资 今日 昨日 本周 上周".split()
NEWS_CATEGORY_RULES = [
    ("股票", "股票 股价 涨停 跌停 a股 港股 美股 上市 ipo".split()), ("基金", "基金 etf 公募 私募 净值 申购 赎回".split()), ("债券", "债券 国债 企业债 可转债 收益率".split()),
    ("宏观经济", "gdp 通胀 利率 汇率 央行 货币政策 经济数据".split()), ("行业分析", "行业 板块 龙头 产业链 供需".split()),
]
NEWS_CATEGORY_DEFAULT = "综合财经"
ANNOUNCEMENT_RULES = [
    ("财务报告", "年报 半年报 季报 财务报告 审计报告".split()), ("重大事项", "重大事项 重大合同 重大投资 重大资产".split()), ("股权变动", "股权变动 增持 减持 股份变动 股东".split()),
    ("业绩预告", "业绩预告 业绩快报 业绩修正".split()), ("停牌复牌", "停牌 复牌 暂停上市 恢复上市".split()), ("分红送股", "分红 送股 转增 派息 利润分配".split()),
    ("关联交易", "关联交易 关联方 关联关系".split()), ("对外投资", "对外投资 投资 收购 并购".split()),
]
ANNOUNCEMENT_DEFAULT = "其他"
IMPORTANT_ANNOUNCEMENT = "重大事项 重大合同 重大投资 重大资产 业绩预告 业绩快报 业绩修正 停牌 复牌 暂停上市 恢复上市 分红 送股 转增 派息 股权变动 增持 减持 关联交易 对外投资 收购 并购".split()
NEWS_URL_EXCLUDE = ["/video/", "/photo/", "/gallery/", "/live/", "/comment/", "/user/", "/login", "/register", "\\.(jpg|jpeg|png|gif|pdf|doc|docx|xls|xlsx)$"]
NEWS_URL_INCLUDE = ["/news/", "/finance/", "/stock/", "/money/", "/business/"]
ANNOUNCEMENT_URL_EXCLUDE = ["/video/", "/photo/", "/gallery/", "/live/", "/comment/", "/user/", "/login", "/register", "\\.(jpg|jpeg|png|gif|doc|docx|xls|xlsx)$"]
ANNOUNCEMENT_URL_INCLUDE = ["/disclosure/", "/announcement/", "/notice/", "/bulletin/", "\\.pdf$"]
REPORT_POSITIVE = "涨 增长 上升 利好 好 优 强 高 升 涨停 买入 推荐".split()
REPORT_NEGATIVE = "跌 下降 下跌 利空 差 弱 低 跌停 亏损 风险 卖出 减持".split()
REPORT_HIGH = "重大 重要 紧急 突发 首次 历史 创新高 创新低 涨停 跌停 停牌 复牌 退市 IPO 并购 重组 监管 政策 央行 证监会 处罚 违规 调查".split()
REPORT_MEDIUM = "公告 披露 变动 调整 增长 下降 合作 签约 业绩 财报 分红 投资 评级".split()
REPORT_SPAM = "测试 广告 推广 联系方式 电话 微信 免费 优惠 特价 限时 秒杀".split()
TOPIC_STOPWORDS = "公司 市场 投资 股票 证券 金融 经济 发展".split()
SUGGESTIONS = "股票分析 市场行情 财报分析 投资策略 风险评估 行业研究 公司公告 政策解读 经济数据 技术分析".split()
SUGGESTION_ENDINGS = "分析报告 投资机会 市场趋势 行业动态 风险评估".split()
# ---------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    name: str
    replacements: list = field(default_factory=lambda: TERM_REPLACEMENTS)
    keyword_stopwords: list = field(default_factory=lambda: KEYWORD_STOPWORDS)
    query_stopwords: list = field(default_factory=lambda: QUERY_STOPWORDS)
    categories: dict = field(default_factory=lambda: CATEGORY_WORDS)
    category_default: str = CATEGORY_DEFAULT
    important_categories: tuple = ("股票相关", "市场动态")
    positive_short: list = field(default_factory=lambda: POSITIVE_SHORT)
    negative_short: list = field(default_factory=lambda: NEGATIVE_SHORT)
    entity_patterns: dict = field(default_factory=lambda: ENTITY_PATTERNS)
    spam_patterns: list = field(default_factory=lambda: SPAM_PATTERNS)
    contact_pattern: str = CONTACT_PATTERN
    value_phrases: list = field(default_factory=lambda: VALUE_PHRASES)
    sentence_end: str = "[。！？]"
    sentence_join: str = "。"
    punctuation: str = "[。！？，；：]"
    positive: list = field(default_factory=lambda: POSITIVE_WORDS)
    negative: list = field(default_factory=lambda: NEGATIVE_WORDS)
    intensity: dict = field(default_factory=lambda: INTENSITY)
    negations: list = field(default_factory=lambda: NEGATIONS)
    shifts: list = field(default_factory=lambda: FINANCE_SHIFTS)
    news_types: dict = field(default_factory=lambda: NEWS_TYPES)
    news_type_default: str = "其他"
    industries: dict = field(default_factory=lambda: INDUSTRIES)
    industry_default: str = "综合"
    importance: dict = field(default_factory=lambda: IMPORTANCE)
    relevance: dict = field(default_factory=lambda: RELEVANCE)
    synonyms: list = field(default_factory=lambda: SYNONYM_GROUPS)
    index_stopwords: list = field(default_factory=lambda: INDEX_STOPWORDS)
    report_positive: list = field(default_factory=lambda: REPORT_POSITIVE)
    report_negative: list = field(default_factory=lambda: REPORT_NEGATIVE)
    report_high: list = field(default_factory=lambda: REPORT_HIGH)
    report_medium: list = field(default_factory=lambda: REPORT_MEDIUM)
    report_spam: list = field(default_factory=lambda: REPORT_SPAM)
    topic_pattern: str = "[一-龥]{2,}"
    topic_stopwords: list = field(default_factory=lambda: TOPIC_STOPWORDS)
    entity_terms: dict = field(default_factory=lambda: ENTITY_TERMS)


ZH_FINANCE = Lexicon("zh_finance")

LATIN_DEMO = Lexicon(
    "latin_demo",
    replacements=[("tion", "TION"), ("ment", "MENT")],
    keyword_stopwords="the of and to in is that it la de le et les que el der die und den en".split(),
    query_stopwords="the of and to in is that it".split(),
    categories={"english": ["thing", "tion "], "german": ["ung", "keit"], "french": ["eau", "ment"], "spanish": ["ción", "ueda"], "junk": ["###", " | ", "!!"]},
    category_default="general",
    important_categories=("junk", "french"),
    positive_short="with for from avec pour con para mit für".split(),
    negative_short="moron scum pathetic loser worthless disgusting idiot clown".split(),
    entity_patterns={"code": "[0-9]{6,}", "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "version": "[0-9]+[.][0-9]+", "acronym": "[A-Z]{3,}"},
    spam_patterns=["moron.*scum", "loser.*idiot", "###.*###", "!!.*!!", "Licensed.*under"],
    contact_pattern="[+][0-9] [(][0-9]+[)]",
    value_phrases=["license", "public", "report", "version", "token", "under", "there", "other", "thing", "stand"],
    sentence_end="[.!?]",
    sentence_join=".",
    punctuation="[.,;:!?]",
    positive="with for from avec pour con para mit für by".split(),
    negative="moron scum pathetic loser worthless disgusting idiot clown on".split(),
    intensity={"the": 1.5, "la": 1.5, "die": 1.5, "a": 0.5, "un": 0.5, "ein": 0.5},
    negations="of no not de nicht".split(),
    shifts=[("thing|tion", 0.2), ("with|avec|con|mit", 0.3), ("moron|scum|loser", -0.3), ("idiot|clown", -0.2), ("###|!!", -0.1)],
    news_types={"note": (["thing", "that", "this"], ["th[a-z]+ing"]), "list": ([" | ", "###"], ["[|].*[|]"]), "licence": (["Licensed", "License"], ["version [0-9]"])},
    news_type_default="other",
    industries={"english": ["the", "and"], "german": ["der", "und"], "french": ["les", "est"], "spanish": ["los", "ción"]},
    industry_default="mixed",
    importance={"high": (["token", "@"], ["[0-9]{10,}"]), "medium": (["Licensed", "version"], ["[0-9]+[.][0-9]+"]), "low": (["###", " | "], ["[!]{2}"])},
    relevance={"high": (["report", "token"], ["[0-9]{6,}"]), "medium": (["that", "which"], ["th[ae]t"]), "low": (["clown", "scum"], ["mor[o]n"])},
    synonyms=["the,le,la,el,der", "and,et,y,und"],
    index_stopwords="of to in is".split(),
    report_positive="with for from avec pour con para mit für good".split(),
    report_negative="moron scum pathetic loser worthless disgusting idiot clown bad".split(),
    report_high=["token", "license", "public"],
    report_medium=["version", "under", "there"],
    report_spam=["###", "$$$", "%%%", "***", "&&&", "!!", " | "],
    topic_pattern="[a-z]{7,}",
    topic_stopwords=["thing"],
    entity_terms={},
)
