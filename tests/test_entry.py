import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.path.insert(0, {root!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:2] == ['lumaflow', 'llm'] or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'flagship' in e.queries() and not any(n.startswith('op') for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_without_training_data_operators():
    subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], check=True)


def test_entry_without_a_library_of_theirs():
    code = CODE.replace("if name.split('.')[:2] == ['lumaflow', 'llm'] or name == 'corpus_pipeline':", "if name in ('tokenizers', 'public_tokenizers', 'sentencepiece', 'regex'):")
    subprocess.run([sys.executable, "-c", code.format(root=str(ROOT))], check=True)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
