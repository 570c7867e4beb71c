"""Fixed values that must equal the reference's for right results.

Labels the rule chains produce and the category lists the filters use, in
the reference's own spelling and order.
"""

# Customer types and account states of the residential population.
RESIDENTIAL_TYPES = ("RESIDENCIAL", "PROGRAMA HOGARES CONECTADOS")
ACTIVE_STATES = ("ACTIVO", "SUSPENDIDO")

# Business segments dropped from the mobile register.
BUSINESS_SEGMENTS = ("Empresas - Empresas", "Empresas - Pymes")

# Junk strings found in the mobile activation-date column.
ACTIVATION_JUNK = (
    "#N/D",
    "SAMSUNG GALAXY A03 CORE 32GB NEGRO",
    "IPHONE 12 PRO MAX GRAFITO 256GB",
    "ARTICULO SIN EQUIPO",
)

# Main movement labels.
MM_SAME = "01. Same RGUs"
MM_UPSELL = "02. Upsell"
MM_DOWNSELL = "03. Downsell"
MM_COMEBACK = "04. Come Back to Life"
MM_NEW = "05. New Customer"
MM_LOSS = "06. Loss"
MM_MISSING = "07. Missing Customer"
GAIN_NEW = "Gross-Ads"
GAIN_COMEBACK = "ComeBackToLife/Rejoiners Gross-Ads"

# Spin labels.
SPIN_UP = "1. Up-spin"
SPIN_DOWN = "2. Down-spin"
SPIN_NONE = "3. No Spin"

# Mobile movement labels.
MOB_MAINTAIN = "01.Maintain"
MOB_DOWNSPIN = "02.Downspin"
MOB_UPSPIN = "03.Upspin"
MOB_LOSS = "04.Loss"
MOB_COMEBACK = "05.Come Back To Life"
MOB_NEW = "06.New Customer"
MOB_GAP = "07.MRC Gap"

# Churn and rejoiner types.
FIXED_VOL = "1. Fixed Voluntary Churner"
FIXED_INVOL = "2. Fixed Involuntary Churner"
FIXED_VOL_REJ = "1. Fixed Voluntary Rejoiner"
FIXED_INVOL_REJ = "2. Fixed Involuntary Rejoiner"
MOBILE_VOL = "1. Mobile Voluntary Churner"
MOBILE_INVOL = "2. Mobile Involuntary Churner"
MOBILE_NONCHURNER = "3. Mobile NonChurner"
MOBILE_VOL_REJ = "1. Mobile Voluntary Rejoiner"
MOBILE_INVOL_REJ = "2. Mobile Involuntary Rejoiner"

# Mobile disconnection reasons and the churn type each maps to.
MOBILE_CHURN_REASONS = (
    ("ALTA/MIGRACION", MOBILE_INVOL),
    ("BAJA INVOLUNTARIA", MOBILE_INVOL),
    ("BAJA PORTABILIDAD", MOBILE_INVOL),
    ("BAJA VOLUNTARIA", MOBILE_VOL),
)

# Service orders.
ORDER_INSTALL = "INSTALACION"
ORDER_UNINSTALL = "DESINSTALACION"
ORDER_DONE = "FINALIZADA"
ORDER_CANCELLED = ("CANCELADA", "ANULADA")
ORDER_REASON_INVOL = "MOROSIDAD"

# Interaction purposes excluded from customer calls.
NON_CALL_PURPOSES = (
    "VENTANILLA", "DESINSTALACION", "CORPORATIVO", "VENCIMIENTO PROMOCION",
    "*NO DEFINIDO*", "SUSPENSIONES", "CREACION DE FACTURA", "VENTAS",
)

# Interaction purposes that are technical tickets.
TECH_TICKET_PURPOSES = (
    "AVERIAS", "SIN SERVICIO INTERNET", "INTERRUPCION CONSTANT SERVICIO",
    "EQUIPO INTEGRADO", "PROB VELOCIDAD", "SIN SEÑAL", "OTRO INTERNET",
    "CONTROL REMOTO", "SIN SERVICIO TV", "PROB STB DIG",
    "SIN SEÑAL UNO/VARIOS CH DVB", "PROB CABLE MODEM", "MENSAJE ERROR DVB",
    "PROB STB DVB", "MENSAJE ERROR", "INTERNET/DIGITAL", "CALIDAD SEÑAL",
    "TV/INTERNET/DIGITAL", "SIN SERVICIO TODOS LOS CH DVB",
    "SIN SERVICIO TELEFONIA", "CONTROL REMOTO DVB", "AVERIA", "PROB STB",
    "SEÑAL LLUVIOSA/RAYAS TV", "CONEXION", "TV/INTERNET",
    "FALTAN CH PARRILLA BASICA DVB", "NIVELES SEÑAL INCORRECTOS INT.",
    "TV/DIGITAL", "SIN SEÑAL UNO/VARIOS CH", "SIN SERVICIO INT",
    "PROB ROUTER CT", "CALIDAD SEÑAL DVB",
)

# Interaction purposes that are billing claims.
BILLING_PURPOSES = (
    "INFORMACION", "MONTO DE FACTURACION", "NOTAS DE CREDITOS",
    "FACTURACION/COBROS", "FORMA DE PAGO", "CAMBIO DE PRECIO",
    "ANULACION DE FACTURA", "COSTO DE SERVICIOS", "ENVIO FACTURA",
    "NOTAS DE CREDITO",
)

# Interaction states that void an interaction.
VOID_STATUSES = ("ANULADA", "CANCELADA")

# FMC status, type, segment and flag labels.
FMC_SOFT = "Soft FMC"
FMC_NEAR = "Near FMC"
FMC_FIXED_ONLY = "Fixed Only"
FMC_MOBILE_ONLY = "Mobile Only"
FMC_TYPE_FIXED = {"1P": "Fixed 1P", "2P": "Fixed 2P", "3P": "Fixed 3P"}
FMC_TYPE_FIXED_0P = "Fixed 0P"
SEG_BY_MIX = {"1P": "P2", "2P": "P3", "3P": "P4", "0P": "P0"}
SEG_P1_FIXED = "P1_Fixed"
SEG_P1_MOBILE = "P1_Mobile"
SEG_P0_FIXED = "P0_Fixed"
WIRELESS = "Wireless"
CHURN_FULL = "Full Churner"
CHURN_FIXED = "Fixed Churner"
CHURN_MOBILE = "Mobile Churner"
CHURN_PREVIOUS = "Previous churner"
CHURN_NONE = "Non Churner"
REJ_FMC = "FMC Rejoiner"
REJ_FIXED = "Fixed Rejoiner"
REJ_MOBILE = "Mobile Rejoiner"

#: Values of the retention file (fixed values).
LOCATED = "CONTACTO EFECTIVO"
RETAINED = "RETENIDO"
