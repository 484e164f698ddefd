"""Licence notices over several lines."""

import textwrap

from conftest import SF_DIR

from wardlight.llm import licences

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
       "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use it.")
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
       "following conditions are met:")
GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
       "License as published by the Free Software Foundation, either version 3 of the License, or any later version.")


def test_wrapped_notices(spark):
    wrap = lambda t, n=72, lead="": "\n".join(lead + x for x in textwrap.wrap(t, n))
    prose = "The old town has a hall and a market, and the moon was seen above the hill in the evening."
    rows = {1: (wrap(MIT), ["mit"]), 2: (wrap(BSD, 78), ["bsd"]), 3: ("/*\n" + wrap(GPL, 70, " * ") + "\n */", ["gpl-3.0"]),
            4: (prose + "\n" + wrap(MIT, 40) + "\n" + prose, ["mit"]), 5: (wrap(prose * 4, 40), []),
            6: (prose + "\nReleased under the MIT License.\n" + prose, ["mit"]),
            7: (wrap(MIT, 76) + "\n\n" + prose + "\n\n" + wrap(BSD, 76), ["bsd", "mit"])}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(i + 10 ** 9, t) for i, (t, _) in rows.items()], "doc_id long, text string"))
    got = {r["doc_id"] - 10 ** 9: r for r in licences.licences(docs).where("doc_id > 999999999").collect()}
    for i, (_, families) in rows.items():
        assert (got[i]["families"], got[i]["n_notices"]) == (",".join(families), len(families)), i
