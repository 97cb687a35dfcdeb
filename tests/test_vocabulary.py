import hashlib

from khatasort.functions import fixed, vocabulary


def test_vocabulary_is_whole_and_in_order():
    v = vocabulary.load()
    assert (len(v.rules), len(v.directory), len(v.commercial)) == (479, 101, 271)
    assert {c for _, c, _ in v.rules} | {c for _, c in v.directory} <= set(fixed.CATEGORIES) and {k for _, _, k in v.rules} == {"token", "phrase"}
    assert hashlib.sha256(repr((v.rules, v.directory, v.commercial)).encode()).hexdigest() == "c7593d3070484b345f35be53e4c8788067dbda9d7bf19177e15a5b37ea716b6f"


def test_another_vocabulary(tmp_path):
    (tmp_path / "rules.csv").write_text("# mine\npattern,category,kind\nblorp,HEALTH,token\n")
    (tmp_path / "directory.csv").write_text("key,category\n")
    (tmp_path / "commercial.csv").write_text("word\nshop\n")
    assert vocabulary.load(str(tmp_path)) == vocabulary.Vocabulary((("blorp", "HEALTH", "token"),), (), ("shop",))


def test_names_of_the_package():
    import khatasort

    assert khatasort.CATEGORIES == fixed.CATEGORIES and khatasort.REVIEW_THRESHOLD == 0.75
    assert callable(khatasort.classify) and callable(khatasort.normalize_merchant) and "classify" in dir(khatasort)
