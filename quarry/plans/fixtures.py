"""A few source files of our own for the code chunkers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "shop/basket.go": 'package shop\n\nimport "errors"\n\n// ErrNoLines is returned for an empty basket.\nvar ErrNoLines = errors.New("no lines")\n\n// Basket holds lines.\ntype Basket struct {\n\tLines []string\n}\n\n// Add puts a line into the basket.\nfunc (b *Basket) Add(line string) {\n\tif line != "{" {\n\t\tb.Lines = append(b.Lines, line)\n\t}\n}\n\nfunc New() *Basket { return &Basket{} }\n',
    "tax/rates.py": '"""Tax rates."""\n\nSTANDARD = 0.2\n\n\n@cached\ndef rate_for(country):\n    """The rate of a country."""\n    return STANDARD\n\n\nclass Table:\n    pass\n',
    "web/cart.js": "// Opens the cart.\nexport function openCart(id) {\n  return fetch(`/cart/${id}`);\n}\n\nconst limit = 5;\n",
    "web/CartView.vue": "<template>\n  <div/>\n</template>\n<script>\n// CartView shows the cart.\nexport default {\n  methods: {\n    total() {\n      return 1;\n    },\n  },\n};\n</script>\n",
    "ui/Panel.qml": "Panel {\n  property int count: 0\n}\n",
    "conf/app.json": '{\n  "server": {\n    "port": 80\n  },\n  "tags": [\n    1\n  ]\n}\n',
    "conf/app.yaml": "server:\n  port: 80\nclient:\n  name: x\n",
    "conf/app.toml": "[server]\nport = 80\n[[routes]]\npath = 'a'\n",
    "conf/app.ini": "[main]\na = 1\n[other]\nb = 2\n",
    "css/site.css": "body {\n  margin: 0;\n}\n.a, .b { color: red; }\n",
    "bin/run.sh": "start() {\n  echo hi\n}\nstop()\n{\n  true\n}\n",
    "page/index.html": "<html>\n<body>\n<div>a</div>\n<h1>b</h1>\n</body>\n</html>\n",
    "README.md": "intro\n# One\ntext\n## Two\nmore\n",
    "notes.txt": "line\n" * 130,
}


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FILES.items()), "file_path string, content string")
