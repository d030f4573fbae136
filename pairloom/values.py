"""Values the results depend on: names, texts and patterns.

Everything in this file is a fixed value: output files, prompts and parsed
judge responses only agree with existing data when these match exactly.
"""

# --- fixed values: rubrics -------------------------------------------------

RUBRICS = [
    "completeness_for_guidelines",
    "clarity_of_core_theme",
    "reference_groundedness",
    "logical_flow",
    "korean_quality",
    "l2_learner_suitability",
]

# Labels used in pair records (score-gap pairs).
RUBRIC_NAMES = {
    "completeness_for_guidelines": "평가 지침 완전성",
    "clarity_of_core_theme": "핵심 주제 명확성",
    "reference_groundedness": "참고자료 기반성",
    "logical_flow": "논리적 흐름",
    "korean_quality": "한국어 품질",
    "l2_learner_suitability": "L2 학습자 적합성",
}

# Labels used in evaluation summaries.
RUBRIC_LABELS = {
    "completeness_for_guidelines": "평가 지침 완성도",
    "clarity_of_core_theme": "핵심주제 명확성",
    "reference_groundedness": "참고자료 기반성",
    "logical_flow": "논리적 흐름",
    "korean_quality": "한국어 품질",
    "l2_learner_suitability": "L2 학습자 적합성",
}

RUBRIC_DESCRIPTIONS = {
    "completeness_for_guidelines": "지문이 주어진 3개의 `공통 조건` 각각에 대한 질문을 모두 만들 수 있을 만큼, 충분하고 균형 잡힌 정보를 포함하고 있는가?",
    "clarity_of_core_theme": "지문이 한국 문화와 외국 문화의 핵심 주제를 명확하고 이해하기 쉽게 제시하고 있는가?",
    "reference_groundedness": "지문이 제공된 참고 자료의 내용을 정확하게 반영하고 근거로 활용하고 있는가?",
    "logical_flow": "지문의 내용이 논리적 순서와 연결성을 갖추어 일관성 있게 구성되어 있는가?",
    "korean_quality": "지문이 문법적으로 올바르고 자연스러운 한국어로 작성되어 있는가?",
    "l2_learner_suitability": "지문이 L2 학습자(한국어를 외국어로 학습하는 사람)에게 적합한 수준과 표현으로 작성되어 있는가?",
}

# Keys a judge may use for a rubric in its JSON answer.
RUBRIC_ALIASES = {
    "completeness_for_guidelines": "is_completeness_for_guidelines",
    "clarity_of_core_theme": "is_clarity_of_core_theme",
    "reference_groundedness": "is_reference_grounded",
    "logical_flow": "is_logical_flow",
    "korean_quality": "has_high_korean_quality",
    "l2_learner_suitability": "is_learner_appropriate",
}

# Template that violates a rubric on purpose -> that rubric.
VIOLATION_TEMPLATES = {
    "passage_agent.violate_flow_severely": "logical_flow",
    "passage_agent.violate_korean_quality_severely": "korean_quality",
    "passage_agent.violate_l2_suitability_severely": "l2_learner_suitability",
    "passage_agent.violate_completeness_severely": "completeness_for_guidelines",
    "passage_agent.violate_clarity_severely": "clarity_of_core_theme",
    "passage_agent.violate_groundedness_severely": "reference_groundedness",
}

# --- fixed values: prompt texts --------------------------------------------

SOURCE_PROMPT = """다음 조건에 맞는 한국어 독해 지문을 생성해주세요.

**주제 정보:**
- 한국어 주제: {korean_topic}
- 외국어 주제: {foreign_topic}

**배경 맥락:**
- 한국어 맥락: {korean_context}
- 외국어 맥락: {foreign_context}

**문제 유형:** {problem_types}

**평가 목표:** {eval_goals}

위 조건들을 모두 반영하여 적절한 한국어 독해 지문을 작성해주세요. 지문은 주어진 주제와 맥락을 포함하고, 지정된 문제 유형과 평가 목표에 적합해야 합니다."""

MARGIN_PROMPT = (
    "두 개의 한국어 독해 지문 A와 B가 주어집니다.\n"
    "두 지문은 모두 아래 [공통 조건]을 바탕으로 생성되었습니다.\n\n"
    "[공통 조건]:\n- 문제 유형: {problem_types}\n- 평가 목표: {eval_goals}\n\n"
    "다음은 생성된 지문의 품질을 평가하는 기준입니다:\n\n"
    "**평가 기준:**\n- {description}\n\n"
    "위 기준에 따라, 두 지문 중 [{name}] 측면에서 더 우수한 것을 선택하세요.\n"
)

DEFAULT_PROBLEM_TYPES = "문화 비교하기, 내용 분석하기, 의견 제시하기"
DEFAULT_EVAL_GOALS = "문화적 차이점과 공통점을 파악하여 비교 분석하는 능력을 평가한다., 주어진 내용의 핵심을 파악하고 분석하는 능력을 평가한다., 문화적 현상에 대한 자신의 의견을 논리적으로 제시하는 능력을 평가한다."

CHAT_TEXT = (
    "<|start_header_id|>user<|end_header_id|>\n\n{prompt}<|eot_id|>"
    "<|start_header_id|>assistant<|end_header_id|>\n\n{response}<|eot_id|>"
)

# --- fixed values: sentinel texts ------------------------------------------

MISSING = "N/A"
STEM_FAILED = "문항 생성 실패"
PASSAGE_FAILED = "생성 실패"
RETRIES_EXCEEDED = "최대 재시도 횟수({n})를 초과했습니다."
REQUEST_ERROR = "오류: {reason}"
BINARY_NOT_PARSED = "JSON 파싱 실패"
BINARY_BAD_JSON = "JSON 형식 오류"
BINARY_NO_METADATA = "평가 메타데이터가 불충분합니다. 문제 유형과 평가 목표가 각각 3개씩 필요합니다."
DETAIL_SKIPPED = "이진 루브릭 평가에서 실패 항목 존재"
PASSED_LABEL = "✅ 통과"
FAILED_LABEL = "❌ 실패"
HIGH_PREFIX = "고품질_"
LOW_PREFIX = "저품질_"
CHAT_METHOD = "POST"
CHAT_URL = "/v1/chat/completions"

# --- fixed values: patterns ------------------------------------------------
# (?U) makes \s and \d Unicode-aware, (?d) keeps \n the only line end. The
# whitespace class adds the four separators the JVM does not count as space.

WHITE_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WS = r"[\s\x1c-\x1f]"
NOT_WS = r"[^\s\x1c-\x1f]"

BRACKETS = [
    r"\([^)]*\)",
    r"\[[^\]]*\]",
    r"\{[^}]*\}",
    r"【[^】]*】",
    r"『[^』]*』",
    r"「[^」]*」",
    r"〈[^〉]*〉",
    r"《[^》]*》",
]

PASSAGE_MARK = "[지문]:"

TITLES = [
    r"^\*\*제목:.*?\*\*\s*\n+",
    r"^제목:.*?\n+",
    r"^\*\*.*?\*\*\s*\n+",
    r"^Title:.*?\n+",
    r"^#.*?\n+",
]

SCORES = [
    r"(\d+)점\s*\([^)]+\)",
    r"(\d+)점",
    r":\s*(\d+)",
    r"(\d+)\s*\(",
    r"(\d+)$",
]

CORRECTION = r"\*\*교정된 문장:\*\*\s*\n?(.*?)(?=\n\*\*|$)"
CHOICE_A = ["선택: A", "선택:A"]
CHOICE_B = ["선택: B", "선택:B"]
SCORE_MARK = "점"

PAGE_TEXT = "문서 제목: {title}\n내용: {summary}..."
PAGE_SEPARATOR = "\n\n---\n\n"

FILE_NAME = r"benchmark_(\d+)_([^_]+)_(.+)"
EVALUATION_FILE = "*eval_rubric*.json"
RECORD_FILE = "rm_pairwise.json"
OPTIONS_TEMPLATE = "passage_options"

# Smallest normalised similarity for each grade, best first; otherwise 1.
GRADES = [(0.99, 5), (0.95, 4), (0.90, 3), (0.80, 2)]
