"""Fixed values that results depend on.

FIXED VALUES — these must stay exactly as written (order included) for the
results to match: dictionary order decides which partial match wins.
"""

# FIXED VALUES: keywords that mark an incident description as dangerous
# (substring test on the upper-cased text; "THEFT, PERSON" is one keyword).
DANGEROUS_KEYWORDS = [
    "HOMICIDE", "MURDER", "MANSLAUGHTER",
    "RAPE", "SODOMY", "SEXUAL", "LEWD",
    "KIDNAPPING", "ABDUCTION", "ROBBERY",
    "ASSAULT", "BATTERY", "AGGRAVATED",
    "INTIMATE PARTNER", "WEAPON", "BRANDISH",
    "SHOTS FIRED", "DISCHARGE FIREARM", "BOMB",
    "EXPLOSIVE", "CRIMINAL THREATS", "THREATENING",
    "BURGLARY", "BREAKING", "PURSE SNATCHING",
    "PICKPOCKET", "THEFT, PERSON", "CHILD STEALING",
    "STALKING",
]

SEVERITY_DANGEROUS = "PELIGROSO"
SEVERITY_SAFE = "SEGURO"

# FIXED VALUES: English incident type -> Spanish label, in dictionary order.
# An exact upper-case hit wins; otherwise the first key contained in the text.
CRIME_TRANSLATIONS = [
    ("BATTERY - SIMPLE ASSAULT", "AGRESIÓN - ASALTO SIMPLE"),
    ("ASSAULT WITH DEADLY WEAPON", "ASALTO CON ARMA MORTAL"),
    ("AGGRAVATED ASSAULT", "AGRESIÓN AGRAVADA"),
    ("INTIMATE PARTNER - SIMPLE ASSAULT", "VIOLENCIA DE PAREJA - ASALTO SIMPLE"),
    ("INTIMATE PARTNER - AGGRAVATED ASSAULT", "VIOLENCIA DE PAREJA - AGRESIÓN AGRAVADA"),
    ("CRIMINAL THREATS", "AMENAZAS CRIMINALES"),
    ("ROBBERY", "ROBO CON VIOLENCIA"),
    ("THEFT", "HURTO"),
    ("THEFT PLAIN - PETTY", "HURTO MENOR"),
    ("THEFT FROM MOTOR VEHICLE", "HURTO DE VEHÍCULO MOTORIZADO"),
    ("THEFT OF IDENTITY", "ROBO DE IDENTIDAD"),
    ("SHOPLIFTING", "HURTO EN TIENDA"),
    ("BURGLARY", "ROBO CON ALLANAMIENTO"),
    ("BURGLARY FROM VEHICLE", "ROBO DE VEHÍCULO"),
    ("PICKPOCKET", "CARTERISTA"),
    ("PURSE SNATCHING", "ROBO DE BOLSO"),
    ("VEHICLE - STOLEN", "VEHÍCULO ROBADO"),
    ("VANDALISM", "VANDALISMO"),
    ("FRAUD", "FRAUDE"),
    ("TRESPASSING", "ALLANAMIENTO DE MORADA"),
    ("BRANDISH WEAPON", "EXHIBIR ARMA"),
    ("WEAPON", "ARMA"),
    ("DISCHARGE FIREARM", "DISPARO DE ARMA DE FUEGO"),
    ("DRUNK ROLL", "ROBO A EBRIO"),
    ("BIKE - STOLEN", "BICICLETA ROBADA"),
    ("DOCUMENT FORGERY", "FALSIFICACIÓN DE DOCUMENTOS"),
    ("EMBEZZLEMENT", "MALVERSACIÓN"),
    ("EXTORTION", "EXTORSIÓN"),
    ("KIDNAPPING", "SECUESTRO"),
    ("RAPE", "VIOLACIÓN"),
    ("SEXUAL", "DELITO SEXUAL"),
    ("HOMICIDE", "HOMICIDIO"),
    ("ARSON", "INCENDIO PROVOCADO"),
]
UNKNOWN_LABEL = "Desconocido"

# FIXED VALUES: question term -> incident type, in insertion order
# (first term contained in the lower-cased question wins).
QUESTION_TERMS = [
    ("robo", "ROBBERY"), ("robos", "ROBBERY"), ("atraco", "ROBBERY"), ("atracos", "ROBBERY"),
    ("homicidio", "HOMICIDE"), ("homicidios", "HOMICIDE"), ("asesinato", "HOMICIDE"),
    ("agresión", "AGGRAVATED ASSAULT"), ("agresiones", "AGGRAVATED ASSAULT"), ("asalto", "ASSAULT"),
    ("violación", "RAPE"), ("violaciones", "RAPE"),
    ("hurto", "THEFT"), ("hurtos", "THEFT"), ("robo menor", "THEFT"),
]

# FIXED VALUES: intent patterns (searched in the lower-cased question).
TREND_PATTERN = (
    r"(tendencia|tendencias|evolución|cambio|a lo largo del tiempo|ha subido|ha bajado|datos anuales|año|años)"
)
COMPARE_PATTERN = (
    r"(diferencia|comparación|comparar|versus|vs|contra|cuál es mejor|cuál es peor|dos zonas|compara)"
)
HOUR_INTERVAL_PATTERN = r"(entre\s+las?\s+(\d{1,2})\s+y\s+las?\s+(\d{1,2}))"

# FIXED VALUES: wording for all types, and the answer to other questions.
ALL_CRIMES_LABEL = "todos los crímenes"
GENERIC_ANSWER = (
    "Soy el cerebro de la API. Pregúntame sobre 'tendencias', 'comparaciones entre zonas' o 'intervalos horarios'."
)

# FIXED VALUES: city bounding box (inclusive) and default map point.
CITY_LAT_MIN, CITY_LAT_MAX = 33.7, 34.35
CITY_LON_MIN, CITY_LON_MAX = -118.7, -118.0
DEFAULT_POINT = (34.05, -118.24)
CITY_SUFFIX = ", Los Angeles, California, USA"
CITY_NAME = "Los Angeles"

# FIXED VALUES: route analysis constants.
DANGER_CONF_MIN = 0.55          # zone / risk point needs severity_confidence above this
RISK_CONF_MIN = 0.20            # risk point needs type confidence above this
INTENSITY_HIGH, INTENSITY_MID = 0.75, 0.60
THREAT_CONF_CENTER, THREAT_CONF_SPAN = 0.65, 0.35
THREAT_MIN_DIST = 0.0001
DETOUR_SIDES = [-1, 1]
DETOUR_DEVIATIONS = [0.10, 0.15, 0.20, 0.25, 0.30]
DETOUR_KEEP = 4
MAX_ROUTES = 6
DUPLICATE_METERS = 100.0
GRID_LONG, GRID_MEDIUM, GRID_SHORT = 10, 8, 6
GRID_LONG_DIST, GRID_MEDIUM_DIST = 0.15, 0.08
GRID_MARGIN = 0.20
PATH_EVERY = 20
PATH_MAX_POINTS = 15
HIST_PATH_EVERY = 10
HIST_BOX = 0.002
HIST_MIN_COUNT = 5

# FIXED VALUES: answer and label formats; {name} marks a value filled in per row.
INTERVAL_ANSWER = "He analizado el período entre las {start}:00 y las {end}:00. Se registraron **{count} incidentes**."
COMPARE_ANSWER = "Comparativa: **{a1}** ({c1}) vs **{a2}** ({c2}). La zona de **{winner}** tiene {diff} crímenes más."
TREND_ANSWER = "La tendencia de '{target}' ha **{trend}** un {pct}% en el último año registrado."
TREND_UP, TREND_DOWN = "subido", "bajado"
RISK_DESCRIPTION = "[RIESGO] {crime} ({pct}%)"
DURATION_LONG = "{h}h {m}min"
DURATION_SHORT = "{m} min"
PLACE_NOT_FOUND = "Dirección no encontrada"
PLACE_OUTSIDE = "Ubicación fuera del área metropolitana de Los Ángeles"

# FIXED VALUES: safety wording for the best route, by its risk-point count.
SAFETY_RATINGS = [
    (0, "Ruta Limpia"),
    (2, "Ruta Muy Segura"),
    (5, "Ruta Segura"),
    (10, "Precaución Moderada"),
]
SAFETY_WORST = "Alto Riesgo"
