"""Word lists, patterns, thresholds and prices that results depend on."""

# Fixed values of the heuristic content analysis.
FACTUAL_WORDS = ("name called age born date time location address phone email company job title position salary price cost amount number count quantity fact information data statistics measurement").split()
PROCEDURAL_WORDS = "how step process method way procedure instruction tutorial guide manual recipe algorithm workflow".split()
EMOTIONAL_WORDS = "feel feeling emotion happy sad angry excited frustrated love hate like dislike prefer enjoy worry concern hope wish dream".split()
IMPORTANT_WORDS = "important critical urgent remember note key essential vital crucial significant main primary".split()
TECHNICAL_WORDS = "api database server client function method algorithm code programming software hardware system network protocol framework library".split()
DROP_PHRASES = ["got it", "ok", "okay", "yes", "no", "thanks", "thank you", "alright", "sure", "right", "i see", "understood", "makes sense", "sounds good", "perfect", "great", "awesome", "cool"]
GENERIC_PREFIXES = ["i understand", "i see", "that makes sense", "good question", "let me help", "i can help", "happy to help", "of course", "certainly", "absolutely", "definitely", "sure thing"]
QUESTION_PREFIXES = "what when where who why how can could would should do does did is are was were".split()
RELATION_MARKS = [" -> ", " relates to ", " is a ", " works at ", " lives in "]

# Fixed patterns. \b and \w are meant as in Python: letters of any script count as word characters.
NAME_PATTERNS = [r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", r"(?i)\bmy name is ([A-Z][a-z]+)", r"(?i)\bi'?m ([A-Z][a-z]+)", r"(?i)\bcalled ([A-Z][a-z]+)"]
MONTHS = "January February March April May June July August September October November December".split()
DATE_PATTERNS = [
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    rf"(?i)\b({'|'.join(MONTHS)})\s+\d{{1,2}},?\s+\d{{4}}\b",
    rf"(?i)\b\d{{1,2}}\s+({'|'.join(m[:3] for m in MONTHS)})\s+\d{{4}}\b",
]
NUMBER_PATTERNS = [r"\b\d+\.\d+\b", r"\b\d{4,}\b", r"\$\d+(?:\.\d{2})?\b"]
ACK_PATTERNS = [r"(?i)^\s*(ok|okay|yes|no|thanks?|got it|understood|alright|sure)\s*[.!]*\s*$", r"^\s*(👍|👌|✓|✅|❤️|🙏)\s*$"]
QUESTION_PATTERNS = [r"\?", rf"(?i)^({'|'.join(QUESTION_PREFIXES)})"]
OF_PATTERN = r"\b\w+ of \w+\b"

# Fixed values of the three-class router's features.
ROUTER_DISCARD = [
    r"\b(ok|okay|thanks?|ty|thx|got it|sounds good|alright)\b",
    r"\b(hi|hello|hey|good morning|good afternoon|good evening)\b",
    r"^\w{1,3}$",
    r"^[^\w]*$",
]
ROUTER_EMOJI = [(0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF)]
ROUTER_FACTUAL = [
    r"\b[A-Z][a-z]+ [A-Z][a-z]+\b",
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"\b\d+(\.\d+)?\b",
    r"\b\w+@\w+\.\w+\b",
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    r"\bat \w+\b|\bin \w+\b",
]
ROUTER_QUESTION = [r"\?", r"\b(what|who|when|where|why|how|can you|could you|would you)\b", r"\b(is|are|do|does|did|will|would|should)\b.*\?"]
ROUTER_ACKS = ["ok", "thanks", "got it", "alright"]
ROUTER_GREETINGS = ["hi", "hello", "hey"]
QUESTION_WORDS = ["what", "who", "when", "where", "why", "how"]

# Fixed values of the other rule policies.
CHITCHAT_EXACT = ["ok", "thanks", "yes", "no", "hi", "hello", "bye"]
CHITCHAT_PARTS = ["ok", "thanks", "yes", "no", "hi", "hello", "bye", "sure"]
SOCIAL_EXACT = ["thanks", "ok", "yes", "no", "great"]
KEY_VALUE_PARTS = ["my", "is", "phone", "address", "id"]
RELATION_PARTS = ["works with", "reports to", "connected to"]
PLACEMENT_PARTS = ["email", "phone", "date", "time", "meeting"]
STRUCTURED_PARTS = ["email", "phone", "@", "meeting", "date"]
PERSONAL_CONTEXT = ["personal", "assistant", "user", "my", "me"]
TECHNICAL_CONTEXT = ["technical", "system", "database", "api", "code"]
CASUAL_CONTEXT = ["casual", "chat", "friend", "conversation"]
TASK_CONTEXT = ["task", "planning", "project", "meeting", "work"]
PERSONAL_INFO = ["my", "i'm", "i am", "name is"]

# Backends in the order in which policies list them.
BACKENDS = [
    ("memory_store", ["fast", "cheap", "searchable"]),
    ("faiss_store", ["vector", "semantic", "fast", "scalable", "persistent"]),
    ("file_store", ["persistent", "cheap", "searchable", "scalable"]),
]

# Fixed prices, in cents, and limits.
WRITE, READ, INDEX, GC, STORAGE_MONTH = 0.05, 0.02, 0.01, 0.005, 0.001
PER_TOKEN, PER_RESULT, PER_LOG_ITEMS = 0.0001, 0.002, 0.001
P50_MS, P95_MS = 50.0, 120.0
SUMMARY_PRICES = [("gpt_4o_mini", 0.08), ("gpt_4o", 0.25), ("claude_3_haiku", 0.04), ("claude_3_sonnet", 0.18), ("local_llama_7b", 0.0001), ("local_llama_13b", 0.0002)]
SIZE_FACTORS = [("small", 1.0), ("medium", 1.5), ("large", 2.0), ("xlarge", 3.0)]
SIZE_LIMITS = [(100, "small"), (500, "medium"), (1000, "large")]
PRESSURE_LIMITS = [(1000, "low"), (10000, "medium"), (100000, "high")]
BUDGETS = [("minimal", 1.0, 0.8), ("standard", 5.0, 4.0), ("premium", 20.0, 16.0), ("unlimited", 1000.0, None)]
OPERATION_LIMIT, SESSION_LIMIT, DAILY_LIMIT, BURST_LIMIT, LEAST_HOURS = 0.1, 10.0, 50.0, 2.0, 0.1

# Fixed values of evaluation: words of refusal, and a template's marks by class.
REFUSALS = ["cannot", "don't know", "insufficient", "not enough", "unable"]
TEMPLATE_EXACT = ["Thanks!", "OK sounds good", "Great!", "Yes"]
TEMPLATE_FIELDS = ["{name}", "{phone}", "{address}"]
TEMPLATE_LINKS = ["connects to", "reports to", "works with"]
PATTERNS = [("personal_assistant", "personal_assistant"), ("technical", "technical_discussion"), ("casual", "casual_chat"), ("task_planning", "task_planning"), ("knowledge", "knowledge_query")]
BENCHMARK_MESSAGES = ["ok", "got it", "My name is Alice Chen", "What is machine learning?", "thanks", "I live in San Francisco", "sounds good", "My phone number is 555-1234"]
BENCHMARK_CASES = [("thanks", "discard"), ("My name is John", "store"), ("What is the weather?", "store"), ("ok", "discard"), ("I work at Google", "store"), ("got it", "discard")]
NAIVE_CENTS, NAIVE_USD, LABEL_USD = 12, 0.001, 0.01
