"""Word lists, units and patterns that results depend on. All of them are defaults of parameters."""

# Money units of compound amounts.
MONEY_UNITS = {"억": 100_000_000.0, "천만": 10_000_000.0, "천": 10_000_000.0, "백만": 1_000_000.0, "백": 1_000_000.0, "만": 10_000.0}

# Words around dates and amounts in a query.
ANNOUNCED = ["공고일", "공개일"]
STARTS = ["입찰 시작", "시작일", "접수 시작"]
DEADLINE = ["마감", "마감일", "입찰 마감", "기한"]
AFTER, BEFORE = ["이후"], ["이전", "까지"]
RANGE_WORDS, AT_LEAST, AT_MOST, CURRENCY = ["~", "에서", "부터", "∼"], ["이상", "초과", "넘는"], ["이하", "미만", "이내"], "원"
DATE_WINDOW = (40, 50)

# Words that the tokenizer leaves out.
STOPWORDS = ["the", "and", "for", "with", "this", "that", "from", "into", "about"]

# What a citation check looks for (tokens, chunk ids, values, pages, answers that found nothing).
TOKEN = r"[A-Za-z0-9_\-]{2,}|[가-힣]{2,}"
CHUNK_ID = r"\b[A-Za-z0-9][A-Za-z0-9_.-]*_\d{4,}\b"
REQUIREMENT_ID = r"\b[A-Z]{2,5}-\d{3,}\b"
DATE_VALUE = r"\d{4}\s*(?:[-./]|년)\s*\d{1,2}\s*(?:[-./]|월)\s*\d{1,2}\s*(?:일)?"
NUMBER_VALUE = r"\d[\d,]*(?:\.\d+)?\s*(?:원|천원|백만원|만원|억원|일|개월|년|명|건|%|won|krw|days?|months?|years?)?"
PAGES = [r"(?:p\.?|page|페이지|쪽)\s*[:.]?\s*(\d+)", r"(\d+)\s*(?:p\.?|page|페이지|쪽)\b"]
NOT_FOUND = r"찾을 수 없|확인할 수 없|관련된 정보를 찾지 못|관련 정보가 없|근거가 없"
SENTENCE_ENDS = ".!?다요니까"
SOURCE_LINE = r"^\s*(?:[-*]\s*)?(?:source|sources|citation|citations|reference|references|file|filename|document|doc|page|section|chunk|출처|근거|파일명|문서|페이지|쪽|섹션|청크|제목|기관|예산|공고일|입찰기간|핵심내용|문서id)\b"
CLAIM_MIN = 8

# Kinds of queries in the order in which their rules are tried.
ROUTE_RULES = [
    ("comparative", r"비교|차이|대비|각각|어떻게\s*다|반면|vs\.|versus|공통점|차이점|더\s*높|더\s*낮|두\s*(?:사업|기관|문서|공고)|여러\s*(?:사업|기관)|사업과\s*.+사업|기관과\s*.+기관"),
    ("summarization", r"요약|정리|요점|개요|전반적|전체적|주요\s*내용|핵심|설명해|소개|어떤\s*사업|무슨\s*사업|어떤\s*내용"),
    ("procedural", r"방법|절차|단계|어떻게|어떤\s*방식|어디에|제출|접수|신청|참여|등록|제안서\s*작성|준비|요구\s*사항|필수|유의\s*사항|주의"),
    ("analytical", r"분석|평가|검토|적합|왜|이유|원인|장점|단점|장단점|강점|약점|문제점|전략|방향|고려|판단|타당|의미|영향"),
    ("factual", r"얼마|몇\s*(?:페이지|점|개|부|명|일|주|달|년|건|%)|최대|최소|상한|하한|제한|기준|조건|몇\s*자|언제|날짜|기간|몇\s*점|합격|배점|가점|가중치|무엇|유형|종류"),
    ("filter_based", r"발주\s*기관|발주처|수요\s*기관|기관명|\d+\s*억|예산|사업비|금액|\d{4}[-./년]\s*\d{1,2}[-./월]\s*\d{1,2}|공고일|마감일|입찰\s*기간|일정|에서\s*발주|이\s*발주한|가\s*발주한"),
]
UNKNOWN = "unknown"

# Search settings by kind of query (mode, k, threshold, prompt, several queries), and what the shipped settings override.
ROUTES = [
    ("factual", "keyword", 3, 0.0, "basic", False), ("comparative", "hybrid", 5, 0.5, "cot_few", True), ("summarization", "vector", 4, 0.55, "basic", False),
    ("procedural", "hyde", 3, 0.55, "cot_zero", False), ("analytical", "mmr", 5, 0.5, "cot_zero", True), ("filter_based", "keyword", 5, 0.0, "basic", False), ("unknown", "hybrid", 3, 0.6, "basic", False),
]
ROUTE_OVERRIDES = [
    ("factual", "hybrid", 5, 0.4, "cot_few", True), ("comparative", "mmr", 10, 0.4, "cot_zero", True), ("summarization", "vector", 7, 0.7, "cot_few", False),
    ("procedural", "hybrid", 5, 0.4, "cot_zero", True), ("analytical", "mmr", 5, 0.7, "cot_zero", True), ("filter_based", "keyword", 5, 0.3, "basic", True), ("unknown", "hybrid", 5, 0.4, "basic", True),
]

# Markers of queries that only the conversation makes clear.
AMBIGUOUS = [
    "첫 번째", "두 번째", "세 번째", "네 번째", "다섯 번째", "첫째", "둘째", "셋째", "1번째", "2번째", "3번째",
    "앞서", "위의", "위에서", "아래의", "이전", "방금", "아까", "직전", "바로 전", "다시", "재설명", "한 번 더", "좀 더", "더 자세히",
    "그 사업", "이 사업", "해당 사업", "본 사업", "동 사업", "그 용역", "이 용역", "해당 용역", "그 RFP", "이 RFP", "해당 RFP",
    "그 공고", "이 공고", "해당 공고", "그 문서", "이 문서", "해당 문서", "그 제안요청서", "해당 제안요청서",
    "그 기관", "이 기관", "해당 기관", "그 발주처", "해당 발주처", "거기서", "거기에서",
    "그 내용", "이 내용", "해당 내용", "그 조건", "이 조건", "해당 조건", "그 금액", "이 금액", "해당 금액", "그 예산", "이 예산", "해당 예산",
    "그 일정", "이 일정", "해당 일정", "그 결과", "이 결과", "해당 결과", "그 항목", "이 항목", "해당 항목", "그 기준", "이 기준", "해당 기준",
    "그럼", "그렇다면", "그렇면", "그래서", "따라서", "그 경우", "다른 건", "다른 것은",
]

# Ranking constants.
RRF_K, HYBRID_RRF_K = 60, 2
MMR_LAMBDA, MMR_SAME_FILE, MMR_POOL = 0.95, 0.25, 100
DENSE_THRESHOLD, RERANK_THRESHOLD = 0.4, 0.35
LEXICAL_WEIGHT, VALUE_WEIGHT = 0.45, 0.55
CLEAR, PARTIAL = 0.55, 0.25
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"
