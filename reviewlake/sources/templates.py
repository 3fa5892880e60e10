"""Go files that the source corpus is made of, one per template number.

Each is complete and holds cases that a rule reports next to cases it does
not. The lines they are expected to be reported on are listed with the
queries' expected results, not here.
"""

GO_TEMPLATES = [
    # 0: panics and exits
    """package shop

import "os"

func check(n int) int {
	if n < 0 {
		panic("negative")
	}
	if n > 9 {
		os.Exit(2)
	}
	log.panic("method")
	cos.os.Exit(3)
	return n
}

func (s *Shop) panic(reason string) {
	s.last = reason
}
""",
    # 1: tested but unhandled errors
    """package shop

func load(path string) error {
	data, err := read(path)
	if err != nil {
	}
	if err := parse(data); err != nil {
		// nothing to do
	}
	if err != nil {
		return err
	} else if err != nil {
	}
	if err == nil {
	}
	if err != nil && len(data) > 0 {
	}
	return err
}
""",
    # 2: mutexes by value
    """package shop

import "sync"

func locks() {
	a := sync.Mutex{}
	b, c := 1, sync.RWMutex{}
	d := &sync.Mutex{}
	guard(sync.Mutex{}, a)
	guard(1,
		sync.RWMutex{})
	e := new(sync.Mutex)
	var f = sync.Mutex{}
	use(a, b, c, d, e, f)
}

func guard(x sync.Mutex, y sync.Mutex) {
}

type Locker interface {
	Take(sync.Mutex)
}
""",
    # 3: printing and comparing
    """package shop

import (
	"fmt"
	"reflect"
)

func show(a, b int, list []int) {
	fmt.Println(fmt.Sprintf("%d", a))
	fmt.Print(fmt.Sprintf("%d", b),
	)
	fmt.Println("x", fmt.Sprintf("%d", a))
	fmt.Println(fmt.Sprintf("%d", a) + "!")
	if reflect.DeepEqual(a, 3) || reflect.DeepEqual(a, "x") {
		fmt.Printf("%v", reflect.DeepEqual(list[0], b))
	}
	_ = reflect.DeepEqual(a, list...)
}
""",
    # 4: comment markers
    """package shop

// TODO: tidy this up
func tidy() int {
	x := 1 // fixme later
	/* a block with a
	   hack inside */
	y := "TODO in a string"
	return x + len(y) // all good
}
// ToDone
""",
    # 5: contexts
    """package shop

import (
	"context"
	"net/http"
)

func fetch(ctx context.Context, url string) {
	http.Get(url)
	http.Do(ctx, url)
	run(func() {
		sql.Query("select 1")
	})
	http.Head(url)
	other.http.Get(url)
}

func nameless(context.Context) {
	http.Post("u")
}

func plain(url string) {
	http.Get(url)
}

func grouped(a, b context.Context) {
	sql.Exec(a)
	sql.Exec(b)
}
""",
    # 6: naked returns
    """package shop

func named(a int) (n int, err error) {
	if a > 0 {
		return
	}
	f := func() {
		return
	}
	f()
	return n, nil
}

func unnamed(a int) (int, error) {
	return a, nil
}

func nothing() {
	return
}

func (s *Shop) count() (total int) { return }

var hook = func() (n int) {
	return
}
""",
    # 7: cancel functions
    """package shop

import "context"

func wait(parent context.Context) {
	a, _ := context.WithCancel(parent)
	b, stop := context.WithTimeout(parent, 5)
	defer stop()
	c, _ := context.WithValue(parent, 1, 2)
	if d, _ := context.WithDeadline(parent, when()); d != nil {
		use(a, b, c)
	}
	var e, _ = context.WithCancel(parent)
	_, f := context.WithCancel(parent)
	use(e, f)
}
""",
    # 8: loops
    """package shop

import "time"

func loop(files []string, ch chan int) {
	for _, f := range files {
		h := open(f)
		defer h.Close()
		if h == nil {
			defer log("nil")
		}
		for {
			select {
			case <-ch:
			case <-time.After(time.Second):
			}
		}
	}
	for i := range []int{1, 2, 3} {
		func() {
			defer done(i)
			time.After(1)
		}()
	}
	defer time.After(2)
}
""",
    # 9: goroutines in loops
    """package shop

func spawn(items []string) {
	for i, item := range items {
		go func() {
			use(i, item)
		}()
		go func(v string) {
			use(v)
		}(item)
		item := item
		go item.run(i)
	}
	for j := 0; j < 3; j++ {
		for _, x := range items {
			go func() {
				go work(j)
				go func() { use(x) }()
			}()
		}
	}
	go func() {
		use(items)
	}()
}
""",
    # 10: code after return
    """package shop

func after(a int) int {
	if a > 0 {
		return 1
		a = 2
		use(a)
	}
	switch a {
	case 1:
		return 1
		use(a)
	}
	{
		return 2
	}
	f := func() int {
		return 3
		return 4
	}
	return f()
	for {
		use(a)
	}
}
""",
    # 11: overwritten values
    """package shop

func twice(in int) int {
	x := 1
	x = 2
	y := in
	y = y + 1
	z := 3
	use(z)
	z = 4
	z += 5
	if in > 0 {
		x = 6
	}
	x = 7
	m, n := pair()
	n, m = pair()
	_ = in
	_ = x
	return y + z + m + n
}
""",
    # 12: overwritten values behind other targets
    """package shop

func behind(s *Shop, i int) {
	i = 1
	s.list[i] = 2
	i = 3
	v := 4
	if i > 0 {
		s.total[v] = 5
	}
	v = 6
	w := 7
	w++
	w = 8
	k := func() int {
		q := 1
		q = 2
		return q
	}
	k = nil
	use(k, v, w)
}
""",
    # 13: struct tags
    """package shop

type Row struct {
	A int    `json:"a"`
	B, C int `json:"b" json:"c"`
	D string `json`
	E string `json:"e`
	F string `json:f`
	G []struct {
		H int `xml:"h" db:"h" xml:"g"`
	} `json:"g" broken`
	I string "yaml:\\"i\\""
	*Base `json:"a\\"b" xml:"c"`
	J func(int)
}

var rows = []Row{{A: 1}, {A: 2}}
""",
    # 14: not a complete file
    """package shop

func broken( {
	panic("never parsed")
	// TODO: nor this
}
""",
    # 15: brackets in texts
    """package shop

const page = `{{ if panic("x") }}
}}} os.Exit(1) // TODO
`

var r = '{'
var s = "}\\"{"

func render() string {
	panic(page + s)
	return string(r)
}
""",
    # 16: literals in headers and generic code
    """package shop

type Pair[K comparable, V any] struct {
	Key K `json:"k" json:"k"`
	Val V
}

func Keys[K comparable, V any](in []Pair[K, V]) (out []K) {
	for _, p := range []Pair[K, V]{{Val: in[0].Val}} {
		defer use(p)
	}
	for _, s := range []struct{ n int }{{1}, {2}} {
		defer use(s)
	}
	for _, q := range []*Shop{nil} {
		defer use(q)
	}
	if n := len([]int{1}); n > 0 {
		return
	}
	for len(out) < in[0]*limit {
		use(in)
	}
	switch v := any(in).(type) {
	case nil:
		return nil
	}
	return out
}
""",
    # 17: clean
    """package shop

// Clean has nothing to report.
func Clean(a int) (int, error) {
	if a == 0 {
		return 0, errEmpty
	}
	total := 0
	for i := 0; i < a; i++ {
		total += i
	}
	return total, nil
}
""",
]
