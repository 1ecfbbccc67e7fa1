"""Words the reports print or compare with.

Fixed values: they have to equal the ones stored in the data and shown in the results.
"""

MONTH_NAMES = (
    "Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho",
    "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro",
)

ONBOARDING_DONE = "Onboarding Completo"
ONBOARDING_OPEN = "Onboarding Não Completo"

HAS_CLASS = "Tem Turma"
NO_CLASS = "Sem Turma"

ANSWERED_ALL = "Respondeu todas"
ANSWERED_PARTLY = "Não respondeu todas"

ALL_STATES = "Todos"
UNKNOWN_STATE = "Não informado"

ONBOARDING_TYPE = "Onboarding"

CHALLENGE_LABELS = {
    "Falta de conhecimento do que fazer após a sondagem": "Falta de conhecimento<br>do que fazer<br>após a sondagem",
    "Falta de conhecimento sobre sondagem": "Falta de conhecimento<br>sobre sondagem",
    "Falta de materiais práticos para realizar a sondagem": "Falta de materiais<br>práticos para<br>realizar a sondagem",
    "Falta de visibilidade do nível da turma": "Falta de visibilidade<br>do nível da turma",
    "Não tenho dificuldade com sondagem": "Não tenho dificuldade<br>com sondagem",
}

DATE_TEXT_PATTERN = r"\d{4}/\d{2}"
