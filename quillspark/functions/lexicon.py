"""Word lists and markers that rules and matching use."""

# Fixed values.
STOPWORDS = (
    "a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "by", "is", "are", "was", "were",
    "be", "been", "being", "that", "this", "it", "its", "as", "at", "from", "but", "not", "does", "do", "did",
    "can", "could", "would", "should", "will", "may", "might", "have", "has", "had",
    "el", "la", "los", "las", "un", "una", "unos", "unas", "y", "o", "de", "del", "en", "con", "por", "para",
    "es", "son", "fue", "eran", "ser", "que", "este", "esta", "esto", "como",
)
ABSTENTION_MARKERS = (
    "no se", "no sé", "no estoy seguro", "no tengo informacion suficiente", "no tengo información suficiente",
    "no hay informacion suficiente", "no hay información suficiente", "insufficient information",
    "not enough information", "i don't know", "i do not know",
    "cannot determine from the information provided", "can't determine from the information provided",
)
NEGATION_MARKERS = (
    "not", "no", "never", "neither", "nor", "without", "false", "incorrect", "did not", "does not", "is not",
    "was not", "nunca", "sin", "falso", "incorrecto", "incorrecta", "no fue", "no es", "no era",
)
AMBIGUOUS_QUESTIONS = (
    "when was he born", "where is it located", "what did they do next", "which one is correct",
    "what does the document say about that", "who directed it", "when did it happen",
    "what is the relationship between them", "which country is it from",
    "what are the relevant benefits in this case", "cuándo nació", "dónde está ubicado",
    "qué dice el documento sobre eso", "cuál fue su cargo", "qué beneficios aplican en este caso",
)
AMBIGUOUS_REFERENCES = (
    "he", "she", "it", "they", "them", "this", "that", "these", "those", "him", "her", "his", "its", "their",
    "one", "someone", "something", "él", "ella", "eso", "ese", "esa", "esto", "este", "esta", "aquel",
    "aquella", "su", "sus", "lo", "la", "ellos", "ellas",
)
NO_ANSWER_MARKERS = (
    "internal employee id", "exact current monthly budget", "official registry number",
    "unpublished access code", "administrative case number", "private access code", "secret code",
    "numero de registro interno", "número de registro interno", "codigo de acceso", "código de acceso",
    "presupuesto mensual actual",
)
MULTI_STEP_CUES = (
    " both ", " compare ", " compared ", " comparison ", " higher ", " older ", " younger ",
    " same nationality", " same neighborhood", " relationship between", " which writer ", " which other ",
    " whose ", " that was formed by ", " starring ", " co-wrote ", " director of ", " singer of ",
    " portrayed ", " administration of a president", " universidad cuyo", " ambos", " ambas", " comparar",
    " cuál de",
)
RETRIEVAL_CUES = (
    "according to the available corpus", "according to the corpus", "available corpus", "in the corpus",
    "context recovered", "retrieved context", "según el corpus", "segun el corpus", "según los documentos",
    "segun los documentos", "documento", "documentos",
)
CONCEPTUAL_CUES = (
    "what is ", "what are ", "explain ", "define ", "why ", "how does ", "qué es ", "que es ", "explic", "defin",
)
ENTITY_OPENERS = (
    "What", "When", "Where", "Who", "Which", "Are", "Is", "The", "A", "An", "According", "Pregunta", "Respond",
    "If", "In", "On", "For", "Can",
)
TRUE_WORDS = ("true", "t", "yes", "y", "1", "sí", "si")
FALSE_WORDS = ("false", "f", "no", "n", "0")
#: Latin-1 letters that decompose into a base letter and a mark, lower case, and the base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
# Fixed values of the sentence policy and of claim extraction.
CLARIFICATION_MARKERS = (
    "need clarification", "needs clarification", "please clarify", "could you clarify", "ambiguous", "unclear",
    "necesito una aclaración", "necesito una aclaracion", "podrías aclarar", "podrias aclarar", "pregunta ambigua",
)
INTRO_MARKERS = (
    "this question asks", "to answer this question", "the answer depends", "we need to determine", "la pregunta pide", "para responder",
)
DOCUMENT_CUES = (
    "document", "documents", "corpus", "evidence", "retrieved", "available context", "according to the available corpus",
    "documento", "documentos", "evidencia", "contexto",
)
FACTUAL_CUES = (
    " was born ", " were born ", " born in ", " born on ", " is located ", " are located ", " located in ", " founded ",
    " written by ", " directed by ", " produced by ", " starring ", " capital of ", " author of ", " singer of ",
    " member of ", " part of ", " belongs to ", " according to ", " completed in ", " released in ", " published in ",
    " nació ", " nacio ", " ubicado ", " fundada ", " fundado ", " escrito por ", " dirigida por ", " dirigido por ",
    " según ", " segun ",
)
COMPARISON_CUES = (
    " both ", " either ", " compare ", " comparison ", " same ", " different ", " higher ", " lower ", " older ",
    " younger ", " before ", " after ", " ambos ", " ambas ", " comparar ", " mismo ", " misma ", " diferente ",
)
META_MARKERS = ("i think", "i believe", "in my opinion", "as an ai", "creo que", "en mi opinión", "en mi opinion")
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
#: Words that tell topics apart; here the topics are languages and the words their commonest ones.
TOPICS = {
    "english": ("the", "of", "and", "that", "with", "for"),
    "german": ("der", "die", "und", "nicht", "ist", "mit"),
    "french": ("le", "les", "des", "une", "pour", "est"),
    "spanish": ("el", "los", "que", "para", "una", "con"),
}

# Fixed values.
NEGATION_BEFORE = ("no", "not", "never", "nunca")

# Marks of an abstention and of a request to clarify, as each kind of evaluation has them.
ABSTENTION = {
    "open": (
        "no se", "no sé", "no estoy seguro", "no tengo informacion suficiente", "no tengo información suficiente",
        "no hay informacion suficiente", "no hay información suficiente", "insufficient information",
        "not enough information", "i don't know", "i do not know",
        "cannot determine from the information provided", "can't determine from the information provided",
    ),
    "retrieved": (
        "no se", "no sé", "no estoy seguro", "no tengo informacion suficiente", "no tengo información suficiente",
        "no hay informacion suficiente", "no hay información suficiente", "informacion insuficiente",
        "información insuficiente", "insufficient information", "not enough information", "i don't know",
        "i do not know", "cannot determine", "can't determine",
    ),
    "adaptive": (
        "no se", "no sé", "no estoy seguro", "no tengo informacion suficiente", "no tengo información suficiente",
        "no hay informacion suficiente", "no hay información suficiente", "informacion insuficiente",
        "información insuficiente", "insufficient information", "not enough information", "i don't know",
        "i do not know", "cannot determine", "can't determine", "not enough evidence", "insufficient evidence",
        "no evidence", "not supported by the context", "not supported by the available context",
    ),
    "active": (
        "no se", "no sé", "no estoy seguro", "no tengo informacion suficiente", "no tengo información suficiente",
        "no hay informacion suficiente", "no hay información suficiente", "informacion insuficiente",
        "información insuficiente", "insufficient information", "not enough information", "i don't know",
        "i do not know", "cannot determine", "can't determine", "not enough evidence", "insufficient evidence",
        "no evidence", "not supported by the context", "not supported by the available context",
        "not supported by the recovered evidence", "the retrieved evidence does not provide",
        "the recovered evidence does not provide",
    ),
    "claims": (
        "no se", "no sé", "no estoy seguro", "no tengo informacion suficiente", "no tengo información suficiente",
        "no hay informacion suficiente", "no hay información suficiente", "informacion insuficiente",
        "información insuficiente", "la evidencia recuperada no alcanza", "no puedo mantenerla",
        "no puedo mantenerla como respuesta confiable", "insufficient information", "not enough information",
        "not enough evidence", "insufficient evidence", "cannot determine", "can't determine", "i don't know",
        "i do not know",
    ),
    "extraction": (
        "not enough information", "insufficient information", "not enough evidence", "insufficient evidence",
        "cannot determine", "can't determine", "cannot be determined", "i don't know", "i do not know",
        "no evidence", "not supported by the context", "not supported by the available context",
        "not supported by the recovered evidence", "no hay información suficiente", "no hay informacion suficiente",
        "información insuficiente", "informacion insuficiente", "no tengo información suficiente",
        "no tengo informacion suficiente", "no se puede determinar", "no puedo determinar",
        "sin evidencia suficiente", "la evidencia recuperada no alcanza",
    ),
}
CLARIFICATION = {
    "adaptive": (
        "necesito una aclaracion", "necesito una aclaración", "necesitaria una aclaracion",
        "necesitaría una aclaración", "podrias aclarar", "podrías aclarar", "por favor aclar", "falta aclarar",
        "pregunta ambigua", "no esta claro", "no está claro", "need clarification", "needs clarification",
        "please clarify", "could you clarify", "ambiguous", "unclear", "not clear who", "not clear what",
        "not clear which",
    ),
    "claims": (
        "necesito una aclaracion", "necesito una aclaración", "podrias aclarar", "podrías aclarar",
        "por favor aclar", "falta aclarar", "pregunta ambigua", "no esta claro", "no está claro",
        "need clarification", "needs clarification", "please clarify", "could you clarify", "ambiguous", "unclear",
    ),
    "extraction": (
        "need clarification", "needs clarification", "please clarify", "could you clarify", "ambiguous", "unclear",
        "not clear who", "not clear what", "not clear which", "necesito una aclaración", "necesito una aclaracion",
        "necesitaría una aclaración", "necesitaria una aclaracion", "podrías aclarar", "podrias aclarar",
        "pregunta ambigua", "no está claro", "no esta claro", "indicá a qué", "indica a que",
    ),
}
