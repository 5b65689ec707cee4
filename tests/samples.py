"""Small documents for the unit tests."""

from __future__ import annotations

import copy
import json


def account(level="1", values=(("dt1", 10),), scope="valoresIndividualizados", **extra):
    made = {"@id": f"c{level}", "@nivel": level, "@descricao": f" Conta {level} ", "@contaPai": ""}
    if values:
        made[scope] = [{"@dtBase": d, "@valor": v} for d, v in values]
    return {**made, **extra}


def filing(**changes):
    """A valid filing; a change to None removes the key."""
    doc = {
        "@cnpj": "01234567",
        "@codigoDocumento": "9011",
        "@tipoRemessa": "I",
        "@dataBase": "122024",
        "@unidadeMedida": 1000,
        "datasBaseReferencia": [{"@id": "dt1", "@data": "A122024"}, {"@id": "dt2", "@data": "S062024"}],
        "BalancoPatrimonial": {"contas": [account("1"), account("2", (("dt1", 7.5), ("dt2", 3)))]},
        "DemonstracaoDoResultado": {"contas": [account("3")]},
        "DemonstracaoDoResultadoAbrangente": {},
        "DemonstracaoDosFluxosDeCaixa": {"contas": [account("4", scope="valoresConsolidados")]},
        "DemonstracaoDasMutacoesDoPatrimonioLiquido": {"contas": [account("5", ())]},
    }
    doc = copy.deepcopy(doc)
    for key, value in changes.items():
        name = key.replace("at_", "@", 1) if key.startswith("at_") else key
        if value is None:
            doc.pop(name, None)
        else:
            doc[name] = value
    return doc


def documents(spark, *docs, names=None):
    rows = [
        (f"/raw/{i:03d}/{n}", n, d if isinstance(d, str) else json.dumps(d, ensure_ascii=False))
        for i, (d, n) in enumerate(zip(docs, names or ["202412-9011-01234567.json"] * len(docs), strict=True))
    ]
    return spark.createDataFrame(rows, "path string, file_name string, text string")
