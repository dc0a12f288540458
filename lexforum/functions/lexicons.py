"""Fixed values of the indicators: patterns, word lists, weights and default scales, as results depend on them."""

from __future__ import annotations

# Denial of victimhood (NV), by mechanism.
NV_COMBATANT = [
    r"\bgrupo(?:s)?\s+(?:al\s+margen\s+de\s+la\s+ley|armado(?:s)?(?:\s+ilegal(?:es)?)?)",
    r"\bintegrante(?:s)?\s+de\s+(?:las?\s+)?(?:farc|eln|auc|bacrim|guerrilla)",
    r"\bmiembro(?:s)?\s+de\s+(?:grupo(?:s)?\s+)?(?:armado|ilegal|irregular)",
    r"\bpresunto(?:s)?\s+(?:guerrillero|terrorista|delincuente|integrante)",
    r"\bobjetivo(?:s)?\s+de\s+(?:alto\s+valor|la\s+operación|interés)",
    r"\bestado\s+(?:mayor|de\s+guerra)",
    r"\bvinculado(?:s)?\s+(?:a|con)\s+(?:grupo(?:s)?\s+)?(?:armado|ilegal|al\s+margen)",
]
NV_WEAPONS = [
    r"\bportaba(?:n)?\s+(?:un\s+)?(?:fusil|pistola|arma|revólver|armamento)",
    r"\btenía(?:n)?\s+en\s+su\s+(?:poder|haber|posesión)\s+(?:material|arma|fusil|munición)",
    r"\bvestía(?:n)?\s+prendas?\s+de\s+uso\s+(?:privativo|militar|castrense)",
    r"\bcon\s+prendas?\s+(?:de\s+uso\s+)?(?:privativo|militar|camuflado)",
    r"\bequipado(?:s?)?\s+con\s+(?:armamento|fusil|armas?)",
    r"\bhalló\s+(?:en\s+su\s+poder\s+)?(?:un\s+)?(?:fusil|arma|pistola|material)",
    r"\bencont(?:ró|raron)\s+(?:en\s+(?:su\s+)?poder\s+)?(?:armamento|armas?|fusil)",
    r"\bkit\s+del?\s+falso\s+positivo",
]
NV_MORAL = [
    r"\bde\s+baja\s+(?:trayectoria|extracción|condición)\s+(?:social|moral)?",
    r"\bvinculado(?:s)?\s+(?:a|con)\s+(?:actividades?\s+ilícitas?|el\s+crimen|el\s+hampa)",
    r"\bcon\s+antecedentes?\s+(?:penales?|judiciales?|delictivos?)",
    r"\bhabitante(?:s)?\s+de\s+(?:la\s+)?calle",
    r"\bconsumidor(?:es)?\s+de\s+(?:sustancias?\s+(?:psicoactivas?|alucinógenas?))",
    r"\b(?:drogadicto|farmacodependiente|adicto)",
    r"\bsin\s+oficio\s+(?:conocido|lícito)",
    r"\bde\s+(?:dudosa|mala|poca)\s+(?:reputación|fama|conducta)",
    r"\bpróximo\s+a\s+(?:grupos?|organizaciones?)\s+(?:criminales?|delincuenciales?)",
]
NV_QUESTIONED = [
    r"\bpresentado(?:s)?\s+(?:falsamente|fraudulentamente|ilegítimamente)\s+como",
    r"\bfalsamente\s+(?:presentado|reportado|identificado)",
    r"\berróneamente\s+(?:identificado|catalogado|clasificado)",
    r"\bque\s+(?:en\s+realidad|realmente)\s+(?:era|eran|no\s+era|no\s+eran)",
    r"\bno\s+era(?:n)?\s+(?:guerrillero|combatiente|delincuente|integrante)",
    r"\b(?:civil|civiles)\s+(?:inocente|inermé|desarmado)",
    r"\bpresentado\s+como\s+(?:guerrillero|baja|resultado)",
]
NV_COMBATANT_LEMMAS = "guerrillero guerrilla insurgente subversivo terrorista narcoterrorista narco delincuente criminal bandido forajido maleante hampón antisocial objetivo blanco enemigo combatiente integrante miembro abatido neutralizado eliminado".split()
NV_WEAPON_LEMMAS = "fusil pistola revólver arma armamento munición explosivo granada caleta material uniforme camuflado prendas".split()
NV_POSSESSION_LEMMAS, NV_POSSESSION_WORDS = "portar tener llevar cargar".split(), ["con", "sin"]
NV_DIRECT_LEMMAS, NV_CONTEXT_LEMMAS = "individuo sujeto elemento tipo".split(), "occiso cadáver cuerpo fallecido".split()
NV_WEIGHTS = {"recategorizacion_combatiente": 1.00, "atribucion_armamento": 0.90, "deshumanizacion": 0.70, "descalificacion_moral": 0.65}
NV_SCALE = (0.0, 0.6, 0.15, 0.18)

# Positive epistemic rupture (REP), by mechanism.
REP_ACKNOWLEDGED = [
    r"\breconoz(?:co|ca|can|cemos)\s+(?:que\s+)?(?:yo\s+)?(?:ordené|participé|cometí|di\s+la\s+orden|fui\s+responsable|mi\s+responsabilidad)",
    r"\b(?:acepto|admito|asumo)\s+(?:plena(?:mente)?|total(?:mente)?)?\s*(?:mi\s+)?responsabilidad",
    r"\bme\s+declaro\s+responsable",
    r"\breconozco\s+(?:mi\s+)?responsabilidad\s+(?:en|por|como)",
    r"\bacepto\s+(?:los\s+)?cargos?\s+(?:que\s+se\s+me\s+imputan?)?",
    r"\bfui\s+(?:yo\s+)?(?:quien|el\s+que)\s+(?:ordené|di\s+la\s+orden|participé)",
    r"\bsoy\s+responsable\s+de",
    r"\breconozco\s+(?:ante\s+(?:las?\s+)?víctimas?|públicamente|la\s+verdad)",
    r"\baporte\s+(?:a\s+la\s+)?verdad\s+(?:completa|plena|detallada|exhaustiva)",
    r"\bverdad\s+(?:completa|plena|detallada|exhaustiva)",
]
REP_IDENTITY = [
    r"\b(?:era|eran|son|fue)\s+(?:un(?:a)?\s+)?civil(?:es)?\s+inocente(?:s)?",
    r"\b(?:era|eran)\s+(?:un(?:a)?\s+)?(?:campesino|trabajador|estudiante|habitante|ciudadano)(?:s)?(?:\s+(?:inocente|desarmado|ajeno))?",
    r"\bno\s+(?:era|eran|tenía|tenían)\s+(?:ninguna\s+)?vinculación\s+(?:con|a)\s+(?:grupo(?:s)?|organización|actividades?)",
    r"\b(?:civil|civiles)\s+(?:inocente(?:s)?|desarmado(?:s)?|ajeno(?:s)?\s+al\s+conflicto)",
    r"\bpersona(?:s)?\s+(?:protegida(?:s)?|inocente(?:s)?|civil(?:es)?)",
    r"\bno\s+(?:portaba|portaban|tenía|tenían)\s+armas?",
    r"\bajeno(?:s)?\s+al\s+conflicto\s+armado",
    r"\bvíctima(?:s)?\s+(?:inocente(?:s)?|civil(?:es)?|directa(?:s)?)",
]
REP_NAMED = [
    r"\bpor\s+la\s+muerte\s+de\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+",
    r"\bla\s+familia\s+(?:de|del)\s+(?:señor|señora|joven)?\s*[A-ZÁÉÍÓÚÑ]",
    r"\bperdón\s+(?:a|de)\s+(?:la\s+familia\s+de\s+)?[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+",
]
REP_LAW = [
    r"\bejecución(?:es)?\s+extrajudicial(?:es)?",
    r"\bhomicidio(?:s)?\s+en\s+persona(?:s)?\s+protegida(?:s)?",
    r"\bcrimen(?:es)?\s+de\s+(?:lesa\s+)?humanidad",
    r"\bcrimen(?:es)?\s+de\s+guerra",
    r"\bmuertes?\s+ilegítimamente\s+presentadas?\s+como\s+bajas?",
    r"\bviolación(?:es)?\s+(?:graves?\s+)?(?:del?\s+)?(?:derecho\s+internacional\s+humanitario|derechos?\s+humanos?|dih)",
    r"\binfracción(?:es)?\s+(?:al|del)\s+(?:dih|derecho\s+internacional\s+humanitario)",
    r"\bpersona(?:s)?\s+protegida(?:s)?\s+por\s+(?:el\s+)?(?:dih|derecho\s+internacional)",
    r"\bart(?:ículo|\.)\s+135\s+(?:del\s+)?(?:código\s+penal|cp)",
    r"\bimpacto\s+(?:en\s+)?(?:las?\s+)?víctimas?",
    r"\bdaño(?:s)?\s+(?:causado(?:s)?|infligido(?:s)?)\s+(?:a\s+)?(?:las?\s+)?víctimas?",
]
REP_REPAIR = [
    r"\bpido\s+perdón\s+(?:a|de|por)",
    r"\bsolicito\s+perdón\s+(?:a|de|por)",
    r"\bme\s+comprometo\s+a\s+(?:no\s+repetir|contribuir|reparar|colaborar)",
    r"\bgarantía(?:s)?\s+de\s+no\s+repetición",
    r"\bno\s+(?:volveré|repetiremos?)\s+(?:a\s+)?(?:cometer|hacer|participar)",
    r"\bofrezco\s+(?:mis\s+)?(?:disculpas?|excusas?)\s+(?:públicas?)?",
    r"\bcontribuiré?\s+(?:a\s+la\s+)?(?:reparación|verdad|búsqueda)",
    r"\bcompromiso\s+(?:de\s+)?(?:reparación|verdad|no\s+repetición)",
    r"\bproyecto(?:s)?\s+(?:de\s+)?(?:reparación|restauración|sanción\s+propia)",
    r"\bsanción\s+propia",
    r"\bjusticia\s+restaurativa",
    r"\bmedida(?:s)?\s+(?:de\s+)?(?:reparación|contribución|satisfacción)",
]
REP_WEIGHTS = {"reconocimiento_responsabilidad": 1.00, "restitución_identidad": 0.90, "lenguaje_dih_reparador": 0.80, "compromiso_reparación": 0.75}
REP_NAMED_FACTOR = 1.1

# Suppressed agency (SA).
SA_LEXICAL = [
    r"\bfue\s+(?:dado\s+de\s+baja|reportado|presentado|registrado|encontrado|hallado|identificado|certificado)\b(?!\s+por\b)",
    r"\bfueron\s+(?:dados\s+de\s+baja|reportados|presentados|registrados|encontrados|hallados|certificados)\b(?!\s+por\b)",
    r"\bse\s+(?:presentó|reportó|registró|procedió|realizó|llevó\s+a\s+cabo|efectuó|desarrolló|ejecutó|verificó)\b",
    r"\b(?:la|el|los|las)\s+(?:presentación|reporte|registro|procedimiento|verificación|identificación|certificación)\s+(?:de|del|como)\b",
    r"\b(?:personal|tropas|efectivos|miembros|integrantes)\s+(?:del?\s+)?(?:ejército|batallón|brigada|unidad|fuerza)",
]
SA_SUFFIXES = "ación ición sión ción miento amiento imiento aje tura ura nte".split()
SA_TRIGGERS = "presentación presentamiento reporte reporto ejecución ejecutoria captura abatimiento neutralización baja bajas procedimiento proceder realización llevamiento efectuación desarrollo cumplimiento resultado resultados contacto operación misión tarea acción actividad".split()
SA_NO_ACTION = "comandante teniente capitán general coronel mayor sargento cabo soldado subteniente brigadier almirante suboficial oficial agente magistrado magistrada juez fiscal defensor representante compareciente imputado procesado acusado testigo estudiante habitante participante integrante miembro presidente vicepresidente gobernante dirigente ambiente accidente incidente expediente antecedente componente continente paciente cliente gerente".split()
SA_INSTITUTIONS = "ejército|fuerzas militares|fuerza pública|batallón|brigada|unidad|tropa|tropas|patrulla|personal|efectivos|la institución|el mando|las fuerzas|el operativo|la misión|el procedimiento|el protocolo".split("|")
SA_REPORT_VERBS = "reportar presentar registrar documentar anotar consignar informar comunicar notificar certificar".split()
SA_WEIGHTS = {"pasiva_sin_agente": 1.0, "se_impersonal": 0.85, "nominalizacion": 0.65, "sujeto_institucional": 0.50, "patron_lexical": 0.75}
SA_REPORT_FACTOR, SA_GENERIC_FACTOR, SA_SUBJECT_FACTOR = 1.3, 0.5, 1.2
SA_ACTION_VERBS = "presentar reportar registrar proceder realizar efectuar llevar desarrollar ejecutar verificar certificar identificar dar establecer".split()
SA_INSTITUTION_VERBS = "proceder realizar reportar presentar efectuar ejecutar dar llevar identificar verificar encontrar hallar".split()
SA_SCALE, REP_SCALE = (0.0, 0.5, 0.12, 0.15), (0.0, 0.4, 0.08, 0.14)

# The civil lexicon, by dimension.
CIVIL = {
    "identidad": "joven muchacho hijo hija padre madre hermano hermana niño niña esposo esposa abuelo abuela familiar pariente compañero amigo vecino persona ciudadano colombiano hombre mujer fair leonardo jaime carlos luis jorge diego andrés camilo mario pedro juan manuel".split(),
    "trabajo": "carpintero campesino agricultor obrero trabajador empleado comerciante vendedor conductor constructor mecánico pintor albañil jornalero cultivador recolector cultivar sembrar cosechar trabajar oficio labor empleo jornal salario sustento trabajo ocupación".split(),
    "cotidianidad": "casa hogar barrio vereda finca pueblo municipio escuela colegio universidad calle parque plaza mercado tienda iglesia cancha desayuno almuerzo comida dormir salir llegar regresar visitar celebrar reunir".split(),
    "vulnerabilidad": ["desarmado", "indefenso", "inocente", "civil", "ajeno", "sin armas", "desprotegido", "vulnerable", "pobre", "humilde", "buscando trabajo", "engañado", "reclutado con engaño", "desaparecido", "buscado", "extrañado", "llorado"],
    "memoria": "memoria recuerdo ausencia dolor sufrimiento lágrimas luto duelo pérdida extrañar verdad justicia reparación reconocimiento madres MAFAPO soacha víctimas buscar identificar cuerpo restos tumba".split(),
}
CIVIL_REPEATS = 3

# Terms of testimony, counted as substrings of the lower-case text.
FIRST_PERSON = "yo nosotros ordené ordenamos maté matamos ejecuté ejecutamos participé participamos reconozco reconocemos acepto aceptamos asumo asumimos fui fuimos di dimos tomé tomamos cometí cometimos".split()
IMPERSONAL = "se produjo|se presentó|se dio de baja|fue dado de baja|fue presentado|se encontró|fue hallado|se reportó|fue reportado|se procedió|fue muerto en|resultó muerto|se identificó|fue identificado como|se neutralizó".split("|")
HEDGES = {
    "tal vez": 1.0, "quizás": 1.0, "quizá": 1.0, "posiblemente": 1.0, "probablemente": 1.0, "en cierta medida": 0.8, "en alguna medida": 0.8,
    "podría": 0.7, "podrían": 0.7, "pudiera": 0.7, "parecería": 0.8, "pareciera": 0.8, "aparentemente": 0.9, "presuntamente": 1.0,
    "supuestamente": 1.0, "al parecer": 0.9, "se estima": 0.6, "se considera": 0.5, "eventualmente": 0.6, "en principio": 0.5,
    "en teoría": 0.7, "según se indica": 0.8, "de alguna manera": 0.7, "de cierta forma": 0.7, "cabe la posibilidad": 0.9, "no se descarta": 0.8,
    "habría": 0.8, "habrían": 0.8, "hubiera": 0.7,
}
EMOTIONS = {
    "culpa": "responsabilidad|responsable|culpable|culpa|reconozco|acepto|perdón|disculpa|lamento|arrepiento|arrepentimiento|vergüenza".split("|"),
    "tristeza": "dolor|sufrimiento|pérdida|duelo|luto|llanto|lágrimas|angustia|pena|aflicción|desconsuelo|desolación|muerte|asesinato".split("|"),
    "miedo": "amenaza|peligro|terror|miedo|temor|intimidación|presión|coerción|riesgo|vulnerabilidad|indefensión".split("|"),
    "ira": "indignación|rabia|furia|injusticia|impunidad|rechazo|condena|repudio|denuncia|reclamo".split("|"),
    "confianza": "verdad|justicia|reparación|reconocimiento|garantía|compromiso|esperanza|fe|dignidad|derecho|restauración".split("|"),
    "anticipacion": "futuro|promesa|compromiso|garantía|no repetición|prevención|transformación|cambio|proceso".split("|"),
    "violencia_institucional": "baja en combate|resultado operacional|dado de baja|neutralizado|abatido|operación|misión táctica|guerrillero|subversivo|delincuente".split("|"),
    "reconocimiento_victimas": "víctima|civil|inocente|persona protegida|familiar|madre|hijo|padre|hermano|comunidad|pueblo|campesino|trabajador".split("|"),
}
VERBAL = "víctima|civil|inocente|reconozco|acepto|responsabilidad|responsable|perdón|lamento|asesinato|homicidio|crimen|delito|ilegal|persona protegida|derecho|dignidad|verdad|reparación|nombre|familia|madre|hijo".split("|")
KEYWORDS = "DETERMINACI|HECHOS Y CONDUCTAS|PATRONES|CALIFICACI|RECONOCIMIENTO|RESUELVE|CONSIDERACIONES|ANTECEDENTES|SUBCASO|CASO 03|ASESINATOS".split("|")

# Kinds of files by extension; corpora by path, in order.
FILE_KINDS = {x: kind for kind, xs in {
    "texto": "txt md rst", "documento": "docx doc pdf rtf", "datos_tabular": "csv tsv xlsx xls parquet feather", "datos_json": "json jsonl", "datos_estructurado": "xml yaml yml",
    "modelo_o_embedding": "pkl pickle npy npz pt pth bin safetensors h5", "audio": "wav mp3 flac m4a", "video": "mp4 mkv webm avi mov", "subtitulo": "srt vtt",
    "codigo": "py sh sql r", "notebook": "ipynb", "log": "log", "config": "cfg ini toml lock", "imagen": "png jpg jpeg svg pdf_thumb",
}.items() for x in xs.split()}
PATH_CORPORA = [
    (r"\bA[-_]?CE\b|consejo[-_]?(de[-_]?)?estado", "A-CE"), (r"\bA[-_]?CSJ\b|corte[-_]?suprema|sala[-_]?penal|casacion", "A-CSJ"), (r"\bB[-_]?JEP\b|srvr|macrocaso[-_]?003", "B-JEP"),
    (r"\bC[-_]?JEP\b|audiencia|catatumbo|costa[-_]?caribe|casanare|dabeiba|huila|ollo|chaparro|torres[-_]?escalante|popa", "C-JEP-oral"),
    (r"mafapo|madres[-_]?(de[-_]?)?(falsos|soacha)", "REF-MAFAPO"), (r"cidh|villamizar|corteIDH|corte[-_]?interamericana", "REF-CIDH"),
]
