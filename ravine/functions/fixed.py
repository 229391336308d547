"""Word lists, formats and maps that results depend on. They are given, not chosen here."""

# Words that are never keywords.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might must shall "
    "can need dare ought used to of in for on with at by from as into through during before after above below "
    "between under again further then once here there when where why how all each few more most other some such "
    "no nor not only own same so than too very just and but if or because until while what which who whom this "
    "that these those am i me my myself we our ours ourselves you your yours"
).split()
# Characters stripped from both ends of a keyword.
KEYWORD_EDGES = ".,!?;:'\"()[]{}"
# Parts of a question that ask for the graph channel.
GRAPH_HINTS = [
    "relationship", "related", "connected", "between", "who", "what company", "which organization", "works for", "belongs to", "part of",
]
# Beginnings of questions by intent.
FACTUAL_STARTS = ["what is", "what are", "define"]
PROCEDURAL_STARTS = ["how do", "how to", "how can"]
COMPARATIVE_HINTS = ["difference", "compare"]
# Phrases by call outcome, in order of precedence.
OUTCOMES = {
    "interested": [
        "interessado", "interested", "sounds good", "parece bom", "vamos fazer", "let's do it", "quero", "i want",
        "me inscreva", "sign me up", "fechado", "agreed",
    ],
    "not_interested": [
        "não interessado", "not interested", "não obrigado", "no thank you", "não agora", "not now", "sem interesse", "no interest",
    ],
    "callback": [
        "ligar depois", "call back", "retornar", "follow up", "semana que vem", "next week", "outro dia", "another day", "me liga", "call me",
    ],
    "demo_scheduled": [
        "agendar", "schedule", "marcar", "book", "appointment", "reunião", "meeting", "demo", "demonstração",
    ],
    "issue_resolved": [
        "resolvido", "resolved", "solucionado", "solved", "ajudou", "helped", "funcionou", "worked", "consertado", "fixed",
    ],
}
# Phrases by sentiment.
POSITIVE = [
    "obrigado", "thank you", "thanks", "ótimo", "great", "excelente", "excellent", "perfeito", "perfect", "maravilhoso",
    "wonderful", "ajudou muito", "very helpful", "agradeço", "appreciate", "bom", "good",
]
NEGATIVE = [
    "frustrado", "frustrated", "decepcionado", "disappointed", "irritado", "angry", "infeliz", "unhappy", "péssimo", "terrible",
    "horrível", "horrible", "ruim", "bad", "problema", "problem",
]
# Query words that ask for tables.
DATA_WORDS = ["table", "data", "numbers", "statistics", "chart", "tabela", "dados"]
# Kinds of files by extension.
FILE_KINDS = {
    "pdf": "pdf", "docx": "docx", "doc": "docx", "txt": "txt", "md": "txt", "csv": "csv", "xlsx": "xlsx", "xls": "xlsx",
    "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "tiff": "image", "tif": "image", "bmp": "image",
}
# MIME types by extension.
MIME_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "csv": "text/csv", "txt": "text/plain", "md": "text/markdown", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
}
# Call states by the provider's names.
CALL_STATES = {
    "queued": "queued", "ringing": "ringing", "in-progress": "in_progress", "completed": "completed",
    "busy": "busy", "failed": "failed", "no-answer": "no_answer", "canceled": "cancelled",
}
# States of a call that has not ended, and a customer's places in the pipeline.
ACTIVE_STATES = ["queued", "ringing", "in_progress"]
CUSTOMER_STATUSES = ["new", "contacted", "qualified", "customer", "lost"]
# What a MIME type has to hold for each kind of file, in the order of the questions.
MIME_KINDS = {"pdf": "pdf", "word": "docx", "document": "docx", "text": "txt", "csv": "csv", "spreadsheet": "xlsx", "excel": "xlsx", "image": "image"}
# Patterns of a heading in the first line of a text, in the order of the questions.
HEADING_PATTERNS = [
    "^#+[ \\t]+(.+?)$", "^([A-Za-z][A-Za-z ]+)$", "^([0-9]+\\.?[ \\t]+.+?)$", "^((?i:chapter)[ \\t]+[0-9]+.*)$", "^((?i:section)[ \\t]+[0-9]+.*)$",
]
# First words of a yes or a no, and the scores of the answers.
YES_WORDS, NO_WORDS = ["sim", "y"], ["não", "n"]
YES_SCORE, NO_SCORE, NO_BUT_YES_SCORE, HOLDS_YES_SCORE, HOLDS_NO_SCORE, UNCLEAR_SCORE = 0.9, 0.1, 0.6, 0.7, 0.3, 0.5
# Texts of chunks without text of their own.
IMAGE_TEXT, SCANNED_TEXT = "[Image]", "[Scanned page - requires OCR]"
# Fact types that have their own bucket.
FACT_TYPES = ["preference", "pain_point", "business_context", "personal", "objection"]
# Separators of the recursive splitter, coarse to fine.
MARKDOWN_SEPARATORS = ["\n## ", "\n### ", "\n#### ", "\n- ", "\n* ", "\n1. "]
SEPARATORS = ["\n\n\n", "\n\n", "\n", ". ", ".\n", "? ", "! ", "; ", ", ", " "]
# Retrieval defaults.
RRF_K = 60
LEXICAL_WEIGHT, SEMANTIC_WEIGHT, GRAPH_WEIGHT = 0.7, 0.8, 1.0
