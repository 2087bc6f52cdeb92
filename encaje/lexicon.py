"""Word lists and patterns that decide what is extracted.

They are data, not logic: every extractor takes its lists from here by default
and accepts others as a parameter. Patterns are written with the short classes
``\\w \\s \\d \\b``, in the Unicode sense; ``functions.text.portable`` spells
them out for the JVM.
"""

from __future__ import annotations

# --- Fixed values: text cleaning -------------------------------------------
EMAIL = r"\S+@\S+"
URL = r"http\S+|www\S+"
PHONE = (
    r"\+?\d{1,3}[-.\s]?\(?\d{1,3}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}"
)
KEPT_PUNCTUATION = r".,;:¿?¡!@#$%&*()-"

# --- Fixed values: CV sections, (headers, stop words) ----------------------
CV_SECTIONS = {
    "personal_info": (
        ["información personal", "datos personales", "perfil", "sobre mí", "acerca de mí"],
        ["educación", "formación", "estudios", "experiencia", "habilidades",
         "competencias", "idiomas", "certificaciones", "proyectos"],
    ),
    "education": (
        ["educación", "formación", "formación académica", "estudios", "formación profesional"],
        ["experiencia", "habilidades", "competencias", "idiomas", "certificaciones",
         "proyectos", "información", "datos personales"],
    ),
    "experience": (
        ["experiencia", "experiencia laboral", "experiencia profesional",
         "historial laboral", "trayectoria profesional"],
        ["educación", "formación", "estudios", "habilidades", "competencias", "idiomas",
         "certificaciones", "proyectos", "información", "datos personales"],
    ),
    "skills": (
        ["habilidades", "competencias", "aptitudes", "conocimientos", "destrezas", "capacidades"],
        ["educación", "formación", "estudios", "experiencia", "idiomas",
         "certificaciones", "proyectos", "información", "datos personales"],
    ),
    "languages": (
        ["idiomas", "lenguajes", "conocimientos lingüísticos", "nivel de idiomas"],
        ["educación", "formación", "estudios", "experiencia", "habilidades", "competencias",
         "certificaciones", "proyectos", "información", "datos personales"],
    ),
    "certifications": (
        ["certificaciones", "certificados", "cursos", "diplomas", "títulos"],
        ["educación", "formación", "estudios", "experiencia", "habilidades", "competencias",
         "idiomas", "proyectos", "información", "datos personales"],
    ),
    "projects": (
        ["proyectos", "trabajos", "portafolio", "portfolio"],
        ["educación", "formación", "estudios", "experiencia", "habilidades", "competencias",
         "idiomas", "certificaciones", "información", "datos personales"],
    ),
}

# --- Fixed values: CV keywords, patterns in output order -------------------
_LEVELS = r"(?:nativo|fluido|avanzado|intermedio|básico)"
TOKEN = r"\b[a-zA-Z0-9#+.]+\b"
CV_KEYWORDS = {
    "education": [
        r"(?:ingenier[ío]a|ingeniero)\s+\w+",
        r"licenciatura\s+en\s+\w+",
        r"grado\s+en\s+\w+",
        r"master\s+en\s+\w+",
        r"doctorado\s+en\s+\w+",
        r"técnico\s+\w+",
        r"bachiller\s+en\s+\w+",
        r"certificado\s+en\s+\w+",
        r"diplomado\s+en\s+\w+",
        r"formación\s+en\s+\w+",
        r"universidad\s+\w+|instituto\s+\w+|escuela\s+\w+",
    ],
    "experience": [
        r"(?:ingeniero|ingeniera)\s+\w+",
        r"desarrollador[a]?\s+\w+",
        r"analista\s+\w+",
        r"gerente\s+\w+",
        r"director[a]?\s+\w+",
        r"coordinador[a]?\s+\w+",
        r"consultor[a]?\s+\w+",
        r"técnico\s+\w+",
        r"especialista\s+\w+",
        r"jefe\s+\w+",
        r"\d+\s+años",
    ],
    "skills": [TOKEN],
    "languages": [
        r"(?:inglés|ingles)\s+" + _LEVELS,
        r"(?:español|espanol)\s+" + _LEVELS,
        r"(?:francés|frances)\s+" + _LEVELS,
        r"(?:alemán|aleman)\s+" + _LEVELS,
        r"(?:italiano)\s+" + _LEVELS,
        r"(?:portugués|portugues)\s+" + _LEVELS,
        r"(?:chino|mandarín|mandarin)\s+" + _LEVELS,
    ],
}

# --- Fixed values: weighted CV text, (section, times) ----------------------
CV_WEIGHTS = [
    ("skills", 2), ("experience", 1), ("education", 1), ("languages", 1),
    ("certifications", 1), ("projects", 1), ("personal_info", 1), ("other", 1),
]
KEYWORD_WEIGHT = 2

# --- Fixed values: job fields, markup route (tags, class pattern, joiner) --
JOB_ELEMENTS = {
    "title": (["h1", "h2"], r"title|job-title|position|puesto|cargo|vacante", ""),
    "company": (["span", "div", "p"], r"company|employer|empresa|empleador", ""),
    "location": (["span", "div", "p"], r"location|address|ciudad|ubicación|dirección", ""),
    "description": (
        ["div", "section"], r"description|details|job-description|descripción|detalles", " "),
    "requirements": (
        ["div", "section", "ul"],
        r"requirements|requisitos|qualifications|perfil|requerimientos", " "),
    "responsibilities": (
        ["div", "section", "ul"],
        r"responsibilities|responsabilidades|funciones|tareas", " "),
    "benefits": (
        ["div", "section", "ul"], r"benefits|beneficios|ofrecemos|ventajas", " "),
}

# --- Fixed values: job fields, text route, first matching pattern wins -----
JOB_LINES = {
    "title": [
        r"(?:puesto|cargo|posición|vacante|oferta):\s*([^\n.]+)",
        r"(?:buscamos|solicitamos)\s+(?:un/a|un|una)\s+([^\n.]+)",
        r"(?:job title|título del trabajo):\s*([^\n.]+)",
    ],
    "company": [
        r"(?:empresa|compañía|organización):\s*([^\n.]+)",
        r"(?:trabajar en|trabajar para|trabajar con)\s+([^\n.]+)",
        r"(?:company|employer):\s*([^\n.]+)",
    ],
    "location": [
        r"(?:ubicación|localización|lugar|ciudad):\s*([^\n.]+)",
        r"(?:location|address|city):\s*([^\n.]+)",
    ],
}

# --- Fixed values: job fields, text route, (headers, stop words) -----------
JOB_SECTIONS = {
    "description": (
        ["descripción del puesto", "descripción del trabajo", "descripción de la oferta",
         "acerca del puesto", "sobre el puesto", "job description", "about the job"],
        ["requisitos", "responsabilidades", "perfil requerido", "requirements",
         "responsibilities"],
    ),
    "requirements": (
        ["requisitos", "requerimientos", "perfil requerido", "perfil del candidato",
         "requirements", "qualifications"],
        ["responsabilidades", "funciones", "beneficios", "ofrecemos", "responsibilities",
         "benefits"],
    ),
    "responsibilities": (
        ["responsabilidades", "funciones", "tareas", "actividades", "responsibilities",
         "duties", "tasks"],
        ["requisitos", "requerimientos", "beneficios", "ofrecemos", "requirements",
         "benefits"],
    ),
    "benefits": (
        ["beneficios", "ofrecemos", "ventajas", "benefits", "we offer", "perks"],
        ["requisitos", "responsabilidades", "requirements", "responsibilities"],
    ),
}

# --- Fixed values: job fields read out of other text -----------------------
JOB_SKILL_PHRASE = (
    r"(?:conocimientos en|conocimiento de|dominio de|manejo de|experiencia con|"
    r"experience with|knowledge of|proficiency in)\s+([^\n.]+)"
)
JOB_EXPERIENCE = r"(?:experiencia|experience)[^\n]*?(?:\d+\s+(?:años|years|año|year))"
_DEGREES = (
    r"(?:grado|licenciatura|ingeniería|técnico|master|doctorado|degree|bachelor|master|phd)"
)
JOB_EDUCATION = r"(?:educación|formación|estudios|education|degree)[^\n]*?" + _DEGREES

# --- Fixed values: job keywords --------------------------------------------
JOB_SKILL_PATTERNS = [
    r"(?:conocimientos|experiencia|dominio|manejo)\s+(?:de|en|con)\s+([a-zA-Z0-9#+.]+)",
    r"(?:conocer|manejar|utilizar|programar\s+en)\s+([a-zA-Z0-9#+.]+)",
    r"(?:habilidades|competencias)\s+(?:de|en|con)\s+([a-zA-Z0-9#+.]+)",
]
TECHNOLOGIES = (
    r"\b(?:java|python|c\+\+|javascript|html|css|sql|nosql|react|angular|vue|node|aws|"
    r"azure|docker|kubernetes|git|agile|scrum|kanban|jira|jenkins|ci/cd)\b"
)
JOB_YEARS = r"\d+\s+(?:años|year|años de experiencia|years of experience)"
JOB_DEGREE = _DEGREES + r"\s+(?:en|in)?\s+\w+"

# --- Fixed values: weighted job text, (field, times) -----------------------
JOB_WEIGHTS = [
    ("title", 3), ("requirements", 2), ("skills", 2), ("responsibilities", 1),
    ("description", 1), ("experience", 1), ("education", 1), ("company", 1),
    ("location", 1), ("benefits", 1),
]

# --- Fixed values: outcome labels and score bands --------------------------
POSITIVE_STATUSES = ["HIRED", "ACCEPTED", "MATCHED"]
NEGATIVE_STATUSES = ["REJECTED", "NOT_MATCHED", "PENDING"]
PAIR_ERROR = "Failed to process CV or job"
EMPTY_ERROR = "empty vocabulary; perhaps the documents only contain stop words"
BANDS = [("high", 80.0), ("medium", 60.0)]
LOWEST_BAND = "low"
ADVICE = {
    True: "suitable",
    False: "not_suitable",
}

# --- Fixed values: elements without an end tag -----------------------------
VOID_TAGS = [
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame",
    "hr", "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta",
    "nextid", "param", "source", "spacer", "track", "wbr",
]
