"""Code-to-label maps, bands and flags of the reports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bizlake.functions.time import as_of_ts, col

# Status codes and the labels the reports print for them.
SALE_ITEM_STATUS = {
    "WAITING": "Aguardando",
    "OUT_OF_STOCK": "Sem estoque",
    "WITHOUT_ART": "Sem arte",
    "ART_REQUIRED": "Sem arte",
    "WITHOUT_GRADE": "Sem grade",
    "GRID_REQUIRED": "Sem grade",
    "IN_ADJUSTMENT": "Em ajuste",
    "TO_PRODUCE": "Para produção",
    "IN_QUOTATION": "Cotação",
    "IN_PRODUCTION": "Em produção",
    "IN_CUSTOMIZATION": "Personalização",
    "WITHDRAWAL": "Retirada",
    "LOGISTICS": "Logística",
    "QUALITY": "Qualidade",
    "DIVERGENT": "Divergente",
    "DELIVERED": "Concluído",
    "CANCELED": "Cancelado",
}
SHIPPING_ORDER_STATUS = {
    "draft": "Rascunho",
    "waiting_logistics": "Aguardando logística",
    "waiting_picking": "Aguardando picking",
    "waiting_mounting": "Aguardando montagem",
    "waiting_labels": "Aguardando etiquetas",
    "waiting_for_printing": "Aguardando impressão",
    "ready_to_ship": "Pronto para envio",
    "shipped": "Enviado",
    "finished": "Concluído",
    "waiting_addresses": "Aguardando endereços",
    "waiting_items_arrival": "Aguardando chegada de itens",
    "canceled": "Cancelado",
    "mounting_with_divergence": "Montagem com Divergência",
    "error": "Erro",
    "withdrawn": "Retirado pelo cliente",
    "ready_for_pickup": "Pronto para retirada pelo cliente",
    "mounting": "Em montagem",
}
QUEUE_STATUS = {
    "error": "01. Erro",
    "waiting_items_arrival": "02. Aguardando chegada de itens",
    "waiting_addresses": "03. Aguardando endereços",
    "waiting_logistics": "04. Aguardando logística",
    "waiting_picking": "05. Aguardando picking",
    "waiting_mounting": "06. Aguardando montagem",
    "mounting": "07. Em montagem",
    "waiting_for_printing": "08. Aguardando impressão",
    "waiting_labels": "09. Aguardando etiquetas",
    "ready_to_ship": "10. Pronto para envio",
    "ready_for_pickup": "10. Pronto para envio",
}
RECEIPT_STATUS = {
    "TO_CHECK": "Aguardando Verificação",
    "TO_PROCESS": "Para Receber",
    "CANCELED": "Cancelado",
    "COMPLETED": "Concluído",
    "FAILURE": "Com Divergência",
}
LOSS_REASON = {
    "kNEADED": "Amassado",
    "RISKS": "Riscado",
    "DEFECTIVE_ART": "Defeito na Arte",
    "NO_ART": "Sem Arte",
}
ASSEMBLY_TYPE = {
    "loose_items": "itens soltos",
    "assembled_and_unsealed": "montado e sem lacre",
    "assembled_and_sealed": "montado e lacrado",
}
CREATED_THROUGH = {
    "customer_app": "App",
    "redeem": "Resgate",
    "admin_app": "Admin - Casos com Erro Inclusos",
}
# Upper edges and labels of the quantity and head-count bands.
QUANTITY_EDGES = (50, 100, 250, 500, 1000)
QUANTITY_LABELS = (
    "1 - Até 50",
    "2 - 51-100",
    "3 - 101-250",
    "4 - 251-500",
    "5 - 501-1000",
    "6 - Acima de 1000",
)
EMPLOYEE_EDGES = (49, 300, 999)
EMPLOYEE_LABELS = (
    "Menor que cinquenta",
    "Entre cinquenta e trezentos",
    "Entre trezentos e mil",
    "Maior que mil",
)
NO_PLAN = "Sem Plano"


def map_labels(c: str | Column, labels: Mapping[str, str], default: str | None = None) -> Column:
    """Label of a code; an unknown code is kept, or becomes ``default`` when given."""
    value = col(c)
    # One literal map: the text is parsed once, when the plan is optimised.
    table = F.from_json(F.lit(json.dumps(labels)), "map<string,string>")
    return F.coalesce(F.try_element_at(table, value), value if default is None else F.lit(default))


def priority(c: str | Column, codes: Sequence[str]) -> Column:
    """1-based position of a code in a list, one past the end for the others."""
    table = F.from_json(F.lit(json.dumps({code: i for i, code in enumerate(codes, start=1)})), "map<string,int>")
    return F.coalesce(F.try_element_at(table, col(c)), F.lit(len(codes) + 1))


def band_label(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first band whose inclusive upper edge holds the value; NULL falls in the last."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one label more than edges")
    value = col(c)
    chain = F
    for edge, label in zip(edges, labels):
        chain = chain.when(value <= edge, F.lit(label))
    return chain.otherwise(F.lit(labels[-1]))


def employee_band(c: str | Column) -> Column:
    return band_label(c, EMPLOYEE_EDGES, EMPLOYEE_LABELS)


def quantity_band(c: str | Column) -> Column:
    return band_label(c, QUANTITY_EDGES, QUANTITY_LABELS)


def age_bucket(due: str | Column, as_of=None) -> Column:
    """Queue age: overdue by more than 30 days, overdue by 1 to 30 days, or still ahead."""
    now, value = as_of_ts(as_of), col(due)
    month_ago = now - F.expr("INTERVAL '30' DAY")
    return (
        F.when(value < month_ago, "Erro")
        .when(value.between(month_ago, now - F.expr("INTERVAL '1' DAY")), "BackLog")
        .otherwise("Demanda Futura")
    )


def rush_label(is_event: str | Column, turbo: str | Column) -> Column:
    event, fast = col(is_event), col(turbo)
    return (
        F.when(event & fast, "TURBO+EVENTO").when(event, "EVENTO").when(fast, "TURBO").otherwise("PADRAO")
    )


def shipping_type(sku_count: str | Column, created_through: str | Column) -> Column:
    """Origin class of a shipment: no article at all, else the channel of the order.

    The reference groups by shipment, so its "every count is zero" test is the
    count of the one shipment; a shipment row that is missing (NULL) is not empty.
    """
    return F.when(col(sku_count) == 0, "Admin - Envio Sem SKU").otherwise(
        map_labels(created_through, CREATED_THROUGH, "Indefinido")
    )


def price_modifier(kind: str | Column, value: str | Column) -> Column:
    amount = col(value)
    return (
        F.when(col(kind) == "PERCENTAGE", (amount / 100).cast("double"))
        .when(col(kind) == "VALUE", amount.cast("double"))
        .otherwise(F.lit(0.0))
    )


def sim_nao(c: Column) -> Column:
    return F.when(c, "sim").otherwise("não")
