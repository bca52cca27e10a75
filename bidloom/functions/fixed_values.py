"""Values that results depend on and that no rule gives: word lists, weights, class ranges, column names."""

# Weights of the ranking factors, and those that need a field of the query.
WEIGHTS = {
    "text": 0.50, "okpd": 0.25, "wins": 0.20, "recency": 0.07, "region": 0.05, "breadth": 0.03, "focus": 0.05,
    "customer_rel": 0.20, "customer_any": 0.05, "price": 0.05, "platform": 0.03,
}
NEEDS = {"customer_rel": "customer_inn", "customer_any": "customer_inn", "price": "price", "platform": "platform"}
CONFIDENCE_SCALE = {"high": 1.0, "medium": 0.85, "low": 0.6}
TOP_LOTS, VOTE_LOTS, VOTE_ITEMS, EXPERIENCED = 8000, 300, 300, 500
CODE_MISMATCH, HALF_LIFE_DAYS, WIN_PRIOR, SIMILAR_ENOUGH, INTENT_BOOST = 0.25, 365, 0.35, 0.35, 4.0
WIN_WEIGHT, PART_WEIGHT = 1.0, 0.5

# Words that the index leaves out.
STOPWORDS = tuple(
    """
а и в во на по с со к ко о об от до из за для при под над без у же ли не ни или либо то это
как что чтобы также а также так том той тот та те их его ее их ним них
поставка оказание услуга выполнение работа закупка приобретение обеспечение нужда
осуществление проведение организация предоставление право заключение договор контракт
государственный муниципальный бюджетный казенный учреждение федеральный закон
санкт-петербург спб г город район здание помещение адрес
гбоу гбдоу гбу гку гбуз гоу гбпоу гбудо фгбу спб гуп сзао оао зао ооо ип
школа гимназия лицей детский сад средний общеобразовательный дошкольный образовательный
январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь
год квартал месяц период полугодие
тип шт штука единица количество объем
адмиралтейский василеостровский выборгский калининский кировский колпинский
красногвардейский красносельский кронштадтский курортный московский невский
петроградский петродворцовый приморский пушкинский фрунзенский центральный
""".split()
)

# What is cut from texts before they are split (law references, numbers, dates, years).
NOISE = (
    r"\(?\s*п\.?\s*\d+\s*ч\.?\s*\d+\s*ст\.?\s*\d+[^)]*\)?",
    r"\b\d{2,3}\s*-\s*фз\b",
    r"федеральн\w*\s+закон\w*",
    r"№\s*[\w/-]+",
    r"\b\d{1,2}\.\d{1,2}\.\d{2,4}\b",
    r"\b(?:19|20)\d{2}\s*(?:г\.?|год\w*)?",
)
TOKEN = r"[а-яa-z0-9]+(?:[-./][а-яa-z0-9]+)*"

# Patterns of years and numbers; Latin keys that may be Russian ones; abbreviations in brackets and the words before them.
YEAR, NUMBER = r"^(19|20)\d\d(-(19|20)?\d\d)?$", r"^\d+([.,]\d+)?$"
CHUNK_KEYS = r"[a-z;',.\[\]`{}:\"<>~]"
CHUNK = rf"(?<![0-9а-яё]){CHUNK_KEYS}+(?![0-9а-яё])"
BRACKET, NAME = r"\(\s*([А-ЯЁA-Z]{2,8})\s*\)", r"[А-Яа-яЁёA-Za-z]+(?:-[А-Яа-яЁёA-Za-z]+)*"

# Limits and weights of the query parser.
LEAST_FREQUENCY, FREQUENT, FREQUENCY_BONUS, MOST_COST, DOCUMENTS = 3, 20, 0.35, 1.0, 1_500_000
KEPT, COUNTED = ("NOUN", "ADJF", "ADJS", "PRTF", "LATN", "NUM", "UNKN", "COMP"), ("шт", "уп", "пар")
SYNONYM, MINED, NARROWER, BROADER, MOST_SYNONYMS, LONGEST_PHRASE = 0.85, 0.75, 0.5, 0.4, 8, 6
SYNONYM_SCALE, DROPPED_WEIGHT, ITEM_WEIGHT = 1.0, 0.5, 0.7

# Stems that tell goods from services.
GOODS = r"\b(поставк|закупк|приобретени|покупк|товар)\w*"
SERVICES = r"\b(оказани|услуг|выполнени|работ|обслуживани|ремонт|монтаж|обучени|вывоз|уборк|охран|аренд)\w*"

# Legal forms and their short forms, in the order in which they are tried.
LEGAL_FORMS = (
    ("ПУБЛИЧНОЕ АКЦИОНЕРНОЕ ОБЩЕСТВО", "ПАО"), ("НЕПУБЛИЧНОЕ АКЦИОНЕРНОЕ ОБЩЕСТВО", "АО"),
    ("ЗАКРЫТОЕ АКЦИОНЕРНОЕ ОБЩЕСТВО", "ЗАО"), ("ОТКРЫТОЕ АКЦИОНЕРНОЕ ОБЩЕСТВО", "ОАО"),
    ("АКЦИОНЕРНОЕ ОБЩЕСТВО", "АО"), ("ОБЩЕСТВО С ОГРАНИЧЕННОЙ ОТВЕТСТВЕННОСТЬЮ", "ООО"),
    ("ФЕДЕРАЛЬНОЕ ГОСУДАРСТВЕННОЕ УНИТАРНОЕ ПРЕДПРИЯТИЕ", "ФГУП"),
    ("ГОСУДАРСТВЕННОЕ УНИТАРНОЕ ПРЕДПРИЯТИЕ", "ГУП"), ("ИНДИВИДУАЛЬНЫЙ ПРЕДПРИНИМАТЕЛЬ", "ИП"),
    ("АВТОНОМНАЯ НЕКОММЕРЧЕСКАЯ ОРГАНИЗАЦИЯ", "АНО"), ("ПРОИЗВОДСТВЕННЫЙ КООПЕРАТИВ", "ПК"),
)

# Market roles, and name patterns that speak for one.
ROLES = {
    "manufacturer": "Производитель",
    "distributor": "Дистрибьютор (оптовая торговля)",
    "supplier": "Поставщик (торговля)",
    "contractor": "Подрядчик",
    "service": "Исполнитель услуг",
}
ROLE_NAMES = {
    "manufacturer": r"завод|фабрик|комбинат|мануфактур|производств|\bнпо\b|\bнпп\b|\bпк\b|агрофирм|птицефабрик|молокозавод|хлебозавод|типографи",
    "distributor": r"торгов\w* дом|\bтд\b|трейд|trade|дистрибуц|дистрибьют|снаб|оптов|\bопт\b|импорт",
    "contractor": r"строй|ремонт|монтаж|инжиниринг",
}

# Columns of the procurement template, and the headings under which each may come.
TEMPLATE = ("procedure_id", "procedure_name", "product_name", "okpd2_code", "quantity", "start_price", "customer_inn", "platform", "is_smp", "publish_date")
HEADINGS = {
    "procedure_id": ("procedure_id", "id", "номер", "номер закупки", "номер процедуры", "№", "n"),
    "lot_id": ("lot_id", "номер лота", "лот", "id лота"),
    "reqnum": ("reqnum", "реестровый номер", "номер извещения", "номер извещения еис"),
    "procedure_name": ("procedure_name", "subject", "name", "наименование закупки", "название закупки", "предмет закупки", "объект закупки", "закупка"),
    "product_name": ("product_name", "item", "позиция", "наименование позиции", "наименование товара", "товар", "тру", "наименование тру", "наименование"),
    "okpd2_code": ("okpd2_code", "okpd2", "окпд2", "код окпд2", "окпд", "код окпд"),
    "quantity": ("quantity", "количество", "кол-во", "колво"),
    "start_price": ("start_price", "price", "нмц", "нмцк", "начальная цена", "начальная максимальная цена", "цена", "сумма"),
    "customer_inn": ("customer_inn", "инн заказчика", "заказчик инн", "заказчик", "инн"),
    "platform": ("platform", "is_eshop_or_aisgz", "площадка", "тип площадки"),
    "is_smp": ("is_smp", "смп", "только смп", "для смп", "субъекты мсп"),
    "publish_date": ("publish_date", "дата", "дата публикации"),
}
SILENT_HEADINGS = ("customer kpp", "кпп заказчика")
YES = ("да", "true", "1", "yes", "y", "истина", "+")
NO = ("нет", "false", "0", "no", "n", "ложь", "-")

# Sentences of statuses and of the confidence.
WON_OF, WON_TENDERS, FEW_WINS = "побед в похожих закупках ({}): ", "победитель похожих процедур ({}): ", "; доля побед ниже 25%"
BY_CODES = " побед по тем же кодам ОКПД2, но не в похожих по названию закупках"
TOOK_PART, BY_CATEGORY = "без побед участвовал в похожих закупках: ", "работал по тем же кодам ОКПД2 или в закупках с общими словами; близких по предмету нет"
APPROXIMATE = "точных совпадений в истории нет — поставщик из ближайших по словам закупок"
FOUND_FEW = "В истории закупок почти нет похожих (найдено {}). Рекомендации приблизительные: показаны поставщики ближайших по словам закупок. Уточните название или добавьте позиции и ОКПД2."
NOT_MET = "В похожих закупках не встречается: {}. Показаны поставщики, подходящие по остальным словам — проверьте, что это то, что вам нужно."
RATHER_FEW = "Похожих закупок в истории немного ({}) — рейтинг менее надёжен, чем обычно."

# Words and headings of the exported tables.
KINDS = {"goods": "товар", "services": "работа/услуга"}
LEVELS = {"high": "высокая", "medium": "средняя", "low": "низкая"}
FROM_HISTORY, FROM_REGISTRY = "история закупок", "новая компания (реестр МСП)"
SUMMARY_HEADINGS = ("Номер закупки", "Номер лота", "Наименование", "Позиций", "ОКПД2", "Тип", "Уверенность подбора", "Замечание", "Найдено из истории", "Новых компаний", "Топ-1", "Топ-2", "Топ-3")
RECOMMENDATION_HEADINGS = ("Номер закупки", "Номер лота", "Место", "ИНН", "Название", "Источник", "Роль", "Статус", "Балл", "Причины", "Телефон", "Email", "ОКВЭД")
