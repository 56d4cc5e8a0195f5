import os

from conftest import SF001

README = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")


def test_readme_usage_example_runs(spark):
    code = open(README).read().split("```python")[1].split("```")[0]
    code = code.replace('"/data"', repr(SF001)).replace("spark = get_spark()", "")
    scope = {"spark": spark}
    exec(code, scope)
    assert scope["tags"].count() > 0
    assert scope["groups"].count() == scope["docs"].count()
