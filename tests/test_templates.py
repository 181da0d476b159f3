import pytest

from colligate.plans import columns, mustache
from colligate.plans.rendering import LoaderError, TemplateSyntaxError, UndefinedError
from colligate.plans.templates import Environment, Options
from colligate.registry import Registry, RegistryError

MUSTACHE = [
    ("Hi {{name}} {{{name}}} {{&name}}", {"name": "<b>"}, "Hi &lt;b&gt; <b> <b>"),
    ("{{#xs}}{{.}},{{/xs}}{{^xs}}none{{/xs}}", {"xs": [1, 2]}, "1,2,"),
    ("{{^xs}}none{{/xs}}", {"xs": []}, "none"),
    ("{{a.b}}|{{#a}}{{b}}{{/a}}", {"a": {"b": 1}}, "1|1"),
    ("  {{! note }}\n{{#t}}\nx\n{{/t}}\n", {"t": True}, "x\n"),
    ("{{=<% %>=}}<% a %>{{a}}", {"a": 1}, "1{{a}}"),
    ("{{#n}}zero{{/n}}", {"n": 0}, "zero"),
]
CASES = [
    ("{{ 1 + 2 * 3 }}|{{ 7 // 2 }}|{{ -7 // 2 }}|{{ 2 ** 3 ** 2 }}|{{ 7 / 2 }}", "7|3|-4|64|3.5"),
    ("{% for x in [1,2,3] if x != 2 %}{{ loop.index }}:{{ x }}{{ ',' if not loop.last }}{% else %}none{% endfor %}", "1:1,2:3"),
    ("{{ ['b','A']|sort|join }}|{{ [3,1,2]|sort(reverse=true)|join }}|{{ ['a','A','b']|unique|join }}", "Ab|321|ab"),
    ("{% for k, g in [{'c':'NY'},{'c':'CA'}]|groupby('c') %}{{ k }}{{ g|length }};{% endfor %}", "CA1;NY1;"),
    ("{{ [1,2]|sum(start=3) }}|{{ [1e16, 1, -1e16]|sum }}|{{ range(5)|batch(2)|list }}|{{ range(5)|slice(2)|list }}", "6|1.0|[[0, 1], [2, 3], [4]]|[[0, 1, 2], [3, 4]]"),
    ("{% macro m(a, b=2) %}{{ a }}{{ b }}{% endmacro %}{{ m(1) }}{{ m(1, b=3) }}", "1213"),
    ("{% set ns = namespace(n=0) %}{% for x in range(4) %}{% set ns.n = ns.n + x %}{% endfor %}{{ ns.n }}", "6"),
    ("{{ missing }}|{{ missing|default('d') }}|{{ missing is defined }}|{{ none }}|{{ true }}", "|d|False|None|True"),
    ("{% for x in 'abc' %}{% if x == 'b' %}{% continue %}{% endif %}{{ x }}{% endfor %}", "ac"),
    ("{% raw %}{{ x }}{% endraw %}{# note #}|{{- ' y' -}} |", "{{ x }}| y|"),
    ("{{ 'abcdef'[1:4] }}|{{ 'abc'[::-1] }}|{{ [1,2,3][-1] }}", "bcd|cba|3"),
    ("{{ 1 < 2 < 3 }}|{{ 'a' in 'abc' }}|{{ 3 not in [1,2] }}|{{ 4 is divisibleby(2) }}", "True|True|True|True"),
    ("{% autoescape true %}{{ '<' }}{{ '<'|safe }}{% endautoescape %}", "&lt;<"),
    ("{% set x %}a{% endset %}{{ x|upper }}{% filter upper %}b{% endfilter %}{% with y = 1 %}{{ y }}{% endwith %}", "AB1"),
    ("{{ {'b': 1, 'a': 2}|dictsort }}|{{ 'foo bar'|title }}|{{ 42.55|round(1) }}|{{ '%s-%d'|format('a', 3) }}", "[('a', 2), ('b', 1)]|Foo Bar|42.5|a-3"),
    ("{{ 1000|filesizeformat }}|{{ 'a b/c'|urlencode }}|{{ {'a': '<'}|tojson }}|{{ '<b>x</b>'|striptags }}", '1.0 kB|a%20b/c|{"a": "\\u003c"}|x'),
    ("{% trans n=2 %}{{ n }} item{% pluralize %}{{ n }} items{% endtrans %}", "2 items"),
    ("{% for x in [1,[2]] recursive %}{{ loop(x) if x is iterable else x }}{% endfor %}", "12"),
    # loops as values
    ("{% for city in ['Rome', 'Oslo'] %}{% set l = loop %}{{ l }}{{ [l]|length }}{{ l|length }}{{ l is iterable }} {% endfor %}", "<LoopContext 1/2>12True <LoopContext 2/2>12True "),
    ("{% for n in [5, 6, 7] %}{{ n }}>{% for m, l in loop %}{{ m }}.{{ l.index }},{% endfor %}{% endfor %}", "5>6.2,7.3,"),
    # macros as values, their callers, defaults and escaping
    ("{% macro price(net, tax=net) %}{{ net }}+{{ tax }}{% endmacro %}{{ price }}|{{ price(3) }}|{{ price.arguments|join }}|{{ price(tax=1) }}", "<Macro 'price'>|3+3|nettax|+1"),
    ("{% macro box() %}[{{ caller('in') }}]{% endmacro %}{% call(where) box() %}{{ where }}{% endcall %}{{ box.caller }}{{ box.explicit_caller }}", "[in]TrueFalse"),
    ("{% macro kept(a) %}{{ a }}{{ kwargs }}{% endmacro %}{{ kept(1, a=2, b=3) }}", "1{'a': 2, 'b': 3}"),
    ("{% macro raw(t) %}{{ t }}{% endmacro %}{% autoescape true %}{{ raw('<i>') }}{{ '<i>' }}{% endautoescape %}", "<i>&lt;i&gt;"),
    # namespaces are no mappings, and show themselves
    ("{% set box = namespace(n=[1]) %}{{ box }}{{ box is mapping }}{{ box == namespace(n=[1]) }}{{ box is sameas(box) }}", "<Namespace {'n': [1]}>FalseFalseTrue"),
    # markup keeps to itself
    ("{% set m = '<p>'|safe %}{{ [m] }}|{{ m[1:] is escaped }}|{{ (m * 2) is escaped }}|{{ m ~ '<q>' }}", "[Markup('<p>')]|True|True|<p><q>"),
    ("{% autoescape true %}{{ '<p>'|safe|replace('p', '<') }}|{{ '<p>'|replace('p', 'q') }}{% endautoescape %}", "<&lt;>|&lt;q&gt;"),
    # identity is not equality
    ("{% set x = [1] %}{{ x is sameas(x) }}|{{ x is sameas([1]) }}|{{ x is eq([1]) }}|{{ none is sameas(other=none) }}|{{ 2 is in(seq=[1, 2]) }}", "True|False|True|True|True"),
]


@pytest.mark.parametrize("template,data,wanted", MUSTACHE)
def test_mustache(template, data, wanted):
    assert mustache.render(mustache.parse(template), data) == wanted


def test_mustache_partials_lambdas_and_errors():
    assert mustache.render(mustache.parse("  {{>p}}\n"), {"x": 1}, {"p": "a{{x}}\nb\n"}) == "  a1\n  b\n"
    assert mustache.render(mustache.parse("{{#f}}x{{/f}}"), {"f": lambda s: s * 2}) == "xx"
    for bad in ("{{#a}}", "{{/a}}", "{{a"):
        with pytest.raises(mustache.MustacheError):
            mustache.parse(bad)


@pytest.mark.parametrize("template,wanted", CASES)
def test_expressions_and_statements(template, wanted):
    assert Environment().from_string(template).render() == wanted


def test_inheritance_and_loading():
    env = Environment({"base": "[{% block a %}base{% endblock %}]", "child": "{% extends 'base' %}{% block a %}{{ super() }}+{% endblock %}", "lib": "{% macro f(x) %}<{{ x }}>{% endmacro %}", "use": "{% import 'lib' as l %}{% from 'lib' import f %}{{ l.f(1) }}{{ f(2) }}{% include ['none', 'base'] %}"})
    assert env.load("child").render() == "[base+]" and env.load("use").render() == "<1><2>[base]"
    with pytest.raises(LoaderError):
        env.load("nope")


def test_errors_have_categories():
    for bad in ("{% if %}", "{{ 1 + }}", "{% for x in y %}", "{{ x|nope }}", "{% endif %}", "{{ 'a' }"):
        with pytest.raises(TemplateSyntaxError):
            Environment().from_string(bad).render()
    with pytest.raises(UndefinedError):
        Environment().from_string("{{ a.b.c }}").render()
    with pytest.raises(UndefinedError):
        Environment(options=Options(strict=True)).from_string("{{ a }}").render()


def test_options():
    env = Environment(options=Options(trim_blocks=True, lstrip_blocks=True))
    assert env.from_string("a\n  {% if true %}\nb\n  {% endif %}\nc").render() == "a\nb\nc"
    env = Environment(options=Options(line_statement_prefix="#"))
    assert env.from_string("# for x in [1,2]\n{{ x }}\n# endfor\n").render() == "1\n2\n"


def test_rows_by_column_and_by_value_agree(spark):
    df = spark.createDataFrame([(1, "ann", [1, 2], -1.5), (2, None, [], 2.0)], "n long, s string, xs array<int>, d double")
    templates = [
        "{{ s|upper }}/{{ n * 2 + 1 }}/{% if d < 0 %}neg{% elif xs %}xs{% else %}pos{% endif %}",
        "{% for x in xs if x > 1 %}{{ loop.index }}={{ x }};{% else %}none{% endfor %}{{ xs|length }}",
        "{{ s|default('x') }}|{{ d }}|{{ n // 2 }}|{{ n is odd }}|{{ s ~ n }}",
    ]
    for t in templates:
        by_column = [r.rendered for r in columns.render_rows(df.fillna("", ["s"]), t).orderBy("n").collect()]
        by_value = [r.rendered for r in columns.render_rows(df.fillna("", ["s"]), t, by_value=True).orderBy("n").collect()]
        assert by_column == by_value
    for t in ("{{s}}{{#xs}}<{{.}}>{{/xs}}{{^xs}}-{{/xs}}",):
        assert [r.rendered for r in mustache.render_rows(df, t).orderBy("n").collect()] == [r.rendered for r in mustache.render_rows(df, t, by_value=True).orderBy("n").collect()] == ["ann<1><2>", "-"]


def test_registry(spark):
    r = Registry()
    r.register("filter", "twice", by_value=lambda x: x * 2)
    r.register("function", "plus", by_value=lambda a, b: a + b)
    with pytest.raises(RegistryError):
        r.register("filter", "twice", by_value=str)
    r.register("filter", "twice", by_value=lambda x: x * 3, replace=True)
    assert r.environment().from_string("{{ 2|twice }}{{ plus(1, 2) }}").render() == "63"
    r.in_sql(spark, "plus", "long")
    assert spark.sql("SELECT plus(1, 2) AS x").first().x == 3
